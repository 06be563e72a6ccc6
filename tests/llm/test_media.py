import base64
import struct
import zlib


from sheaf.llm import media, queries


def png():
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = base64.b64decode("R0lGODlhAQABAIAAAAAAAP///yH5BAEAAAAALAAAAAABAAEAAAIBRAA7")


def test_finds_carves_and_corrects(spark):
    p = png()
    rows = [(1, p, "image/jpeg"), (2, b"xx" + GIF + b"yy" + p + b"z", "text/plain"), (3, b"BM not a bitmap RIFF....WAVE", "image/bmp"), (4, None, None), (5, b"", "a"), (6, p[:-1], "image/png"), (7, GIF, "image/gif")]
    df = spark.createDataFrame(rows, "k long, media binary, declared string")
    got = {r["k"]: r for r in media.sniff(df, declared="declared").collect()}
    assert [(got[k]["media_type"], got[k]["corrected"]) for k in range(1, 8)] == [("image/png", True), (None, False), (None, False), (None, False), (None, False), (None, False), ("image/gif", False)]
    assert [(e["type"], e["start"], e["length"]) for e in got[2]["embedded"]] == [("image/gif", 2, len(GIF)), ("image/png", 4 + len(GIF), len(p))]
    carved = {(r["k"], r["part_start"]): bytes(r["part"]) for r in media.carve(df).collect()}
    assert carved == {(1, 0): p, (2, 2): GIF, (2, 4 + len(GIF)): p, (7, 0): GIF}


def test_round_trip(odd_docs):
    read = media.read_samples(media.sniff(media.store_text(odd_docs)))
    for r in read.collect():
        data = (r["text"] or "").encode()
        assert bytes(r["payload"]) == media.pad(data) and len(r["payload"]) % 64 == 0 and len(r["payload"]) > 0 and r["media_type"] == "audio/wav"
        assert bytes(r["media"]) == media.to_wav(media.pad(data))
    assert media.store_text(odd_docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    import hashlib

    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op5_media(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        p = media.pad(texts[r["doc_id"]].encode())
        assert (r["n_bytes"], r["payload_bytes"]) == (len(texts[r["doc_id"]].encode()), len(p))
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-64:])

