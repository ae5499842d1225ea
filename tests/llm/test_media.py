import hashlib
import zlib

from tracewell.llm import media

DDL = "doc_id long, text string, digest string, html string, media string, caption long"
ROWS = [(1, "plain text", "d", "h", "m", 1), (2, None, None, None, None, None), (3, "", None, None, None, None), (4, "<b>&amp; 1 < 2 > 0</b> &lt;<script>x</script>", None, None, None, None), (5, "é" * 70_000, None, None, None, None), (6, "plain text", None, None, None, None), (6, "plain text", None, None, None, None), (7, "a" * 576, None, None, None, None), (None, "no id", None, None, None, None)]


def test_round_trip(spark):
    docs = spark.createDataFrame(ROWS, DDL)
    figures = media.sequences(media.document_pages(docs), "doc_id")
    texts = {r.doc_id: r.text for r in figures.where("kind = 'text'").collect()}
    assert texts[4] == ROWS[3][1] and texts[1] == "plain text" and 2 not in texts
    got = media.resolve(figures.where("kind = 'media'"), media.store_texts(docs)).collect()
    assert len(got) == len(ROWS)
    want = {r[0]: media.pad((r[1] or "").encode()) for r in ROWS}
    for r in got:
        payload = want[r.doc_id]
        assert len(payload) % 576 == 0 and r.payload_bytes == len(payload) and r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:])
        png = media.to_png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest()) and r.caption.startswith("bytes ")
    assert media.resolve(media.sequences(media.document_pages(docs.limit(0)), "doc_id"), media.store_texts(docs.limit(0))).count() == 0


def test_interleaving_keeps_order_and_captions(spark):
    html = '<p>one <b>two</b></p><img src="media:aa" alt="first"><p>three</p><figure><img src="http://x/b.png"><figcaption>cap &amp; more</figcaption></figure><script>no()</script>tail'
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<img>")], "page_id long, html string")
    got = [(r.kind, r.text, r.digest, r.caption) for r in media.sequences(pages).orderBy("position").collect()]
    assert got == [("text", "one two", None, None), ("media", None, "aa", "first"), ("text", "three", None, None), ("media", None, "http://x/b.png", "cap & more"), ("text", "tail", None, None)]
    broken = spark.createDataFrame([("aa", bytearray(b"nothing")), (None, None)], "digest string, media binary")
    rows = media.resolve(media.sequences(pages), broken).where("digest = 'aa'").collect()
    assert rows[0].feature is None and rows[0].media_bytes == 7
