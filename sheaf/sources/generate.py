"""Generated tables: each cell is a function of seed, row and column, so any number of tasks makes the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that generated texts are made of.
FIRST = ["Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gina", "Hugo", "Iris", "Jon", "Kira", "Leo", "Mia", "Noel", "Olga", "Paul"]
LAST = ["Adler", "Brook", "Clark", "Dunn", "Ellis", "Frost", "Grant", "Hayes", "Irwin", "Jones", "Keller", "Lane", "Moss", "Nolan", "Owens", "Price"]
WORDS = ["amber", "birch", "cloud", "delta", "ember", "field", "grove", "harbor", "island", "juniper", "kernel", "lumen", "meadow", "north", "orbit", "pebble"]
CITIES = ["Athens", "Berlin", "Cairo", "Dublin", "Evora", "Fukuoka", "Geneva", "Hanoi", "Izmir", "Jakarta", "Kyoto", "Lima", "Madrid", "Nairobi", "Oslo", "Porto"]
COUNTRIES = ["Austria", "Brazil", "Canada", "Denmark", "Egypt", "France", "Greece", "Hungary", "India", "Japan", "Kenya", "Latvia", "Mexico", "Norway", "Oman", "Peru"]
CURRENCIES = ["AUD", "BRL", "CAD", "CHF", "CNY", "EUR", "GBP", "INR", "JPY", "KRW", "MXN", "NOK", "NZD", "SEK", "USD", "ZAR"]


@dataclass(frozen=True)
class Field:
    """A generated column: a type, or values to choose from, or a function of (row id, random long) columns."""

    type: str = "string"
    min: float | None = None
    max: float | None = None
    length: int = 8
    values: Sequence[object] | None = None
    nullable: float = 0.0
    make: Callable[[Column, Column], Column] | None = None
    name: str | None = None


def _pick(items: Sequence[object], h: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (F.pmod(h, F.lit(len(items))) + 1).cast("int"))


def _cell(f: Field, row: Column, hash_: Callable[[str], Column]) -> Column:
    h = hash_("")
    unit = F.pmod(h, F.lit(1 << 52)) / float(1 << 52)
    low, high = f.min if f.min is not None else 0, f.max if f.max is not None else 1000
    lower = F.lower
    part = lambda tag, items: _pick(items, hash_(tag))
    hexes = lambda tag, n: F.substring(F.sha2(hash_(tag).cast("string"), 256), 1, n)
    words = lambda n: F.concat_ws(" ", *(part(f"w{i}", WORDS) for i in range(n)))
    byte = lambda tag: F.pmod(hash_(tag), F.lit(256)).cast("string")
    digits = lambda tag, n: F.lpad(F.pmod(hash_(tag), F.lit(10**n)).cast("string"), n, "0")
    start = F.lit("2020-01-01").cast("date")
    known: dict[str, Callable[[], Column]] = {
        "string": lambda: hexes("s", f.length),
        "int": lambda: (F.floor(unit * (high - low + 1)) + low).cast("long"),
        "float": lambda: F.round(unit * (high - low) + low, 4),
        "bool": lambda: F.pmod(h, F.lit(2)) == 1,
        "date": lambda: F.date_add(start, F.pmod(h, F.lit(2000)).cast("int")),
        "datetime": lambda: F.timestamp_seconds(F.lit(1577836800) + F.pmod(h, F.lit(172_800_000))),
        "timestamp": lambda: F.lit(1577836800000) + F.pmod(h, F.lit(172_800_000_000)),
        "uuid": lambda: F.concat_ws("-", hexes("a", 8), hexes("b", 4), F.concat(F.lit("4"), hexes("c", 3)), F.concat(_pick("89ab", hash_("v")), hexes("d", 3)), hexes("e", 12)),
        "email": lambda: F.concat(lower(part("f", FIRST)), F.lit("."), lower(part("l", LAST)), digits("n", 2), F.lit("@example.com")),
        "name": lambda: F.concat_ws(" ", part("f", FIRST), part("l", LAST)),
        "firstName": lambda: part("f", FIRST),
        "lastName": lambda: part("l", LAST),
        "word": lambda: part("w", WORDS),
        "sentence": lambda: F.concat(F.initcap(part("w0", WORDS)), F.lit(" "), words(6), F.lit(".")),
        "paragraph": lambda: F.concat(words(24), F.lit(".")),
        "phone": lambda: F.concat(F.lit("+1-555-"), digits("a", 3), F.lit("-"), digits("b", 4)),
        "url": lambda: F.concat(F.lit("https://example.com/"), part("w", WORDS), F.lit("/"), digits("n", 4)),
        "ip": lambda: F.concat_ws(".", byte("a"), byte("b"), byte("c"), byte("d")),
        "ipv6": lambda: F.concat_ws(":", *(hexes(f"g{i}", 4) for i in range(8))),
        "hex": lambda: hexes("h", f.length),
        "index": lambda: row,
        "company": lambda: F.concat_ws(" ", F.initcap(part("w", WORDS)), _pick(["Ltd", "Inc", "GmbH", "SA"], hash_("k"))),
        "country": lambda: part("c", COUNTRIES),
        "currency": lambda: part("c", CURRENCIES),
        "percent": lambda: F.round(unit * 100, 2),
        "city": lambda: part("c", CITIES),
        "zipCode": lambda: digits("z", 5),
        "color": lambda: F.concat(F.lit("#"), hexes("c", 6)),
        "username": lambda: F.concat(lower(part("f", FIRST)), F.lit("_"), digits("n", 3)),
        "slug": lambda: F.concat_ws("-", *(part(f"w{i}", WORDS) for i in range(3))),
    }
    if f.make is not None:
        out = f.make(row, h)
    elif f.values:
        out = _pick(f.values, h)
    elif f.type in known:
        out = known[f.type]()
    else:
        raise ValueError(f"unknown type: {f.type}")
    if f.nullable:
        out = F.when(F.pmod(hash_("null"), F.lit(10_000)) >= F.lit(int(f.nullable * 10_000)), out)
    return out


def generate(spark: SparkSession, rows: int, fields: Sequence[Field | str], seed: int = 42, partitions: int | None = None) -> DataFrame:
    """rows rows of the given columns, named <type>_<place> unless they have names."""
    listed = [f if isinstance(f, Field) else Field(f) for f in fields]
    base = spark.range(rows, numPartitions=partitions) if partitions else spark.range(rows)
    cells = []
    for i, f in enumerate(listed):
        hash_ = lambda tag, i=i: F.xxhash64(F.lit(seed), F.col("id"), F.lit(i), F.lit(tag))
        cells.append(_cell(f, F.col("id"), hash_).alias(f.name or f"{f.type}_{i}"))
    return base.select(*cells)


def generate_stream(spark: SparkSession, rows_per_second: int, fields: Sequence[Field | str], seed: int = 42) -> DataFrame:
    """The same columns over a rate source, without end."""
    listed = [f if isinstance(f, Field) else Field(f) for f in fields]
    base = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    cells = []
    for i, f in enumerate(listed):
        hash_ = lambda tag, i=i: F.xxhash64(F.lit(seed), F.col("value"), F.lit(i), F.lit(tag))
        cells.append(_cell(f, F.col("value"), hash_).alias(f.name or f"{f.type}_{i}"))
    return base.select("timestamp", *cells)
