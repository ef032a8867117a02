import tracemalloc
import zlib

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sievemark.llm import langid

SF = "/root/testdata/sf0.01/documents.parquet"
ROWS = [(i, x, "en") for i, x in enumerate(["the them and of they", None, "", "123 !!", "é", "the " * 6000, "漢字"])]


def test_held_out_documents_are_told_apart(spark):
    docs = pq.read_table(SF).to_pandas()
    held = np.array([zlib.crc32(str(x).encode()) % 4 == 2 for x in docs["doc_id"]])
    got = {r.doc_id: r for r in langid.identify(spark.read.parquet(SF)).collect()}
    assert len(got) == len(docs) and all(got[i].held_out == bool(h) for i, h in zip(docs["doc_id"], held, strict=True))
    right = [got[i].lang_pred == lang for i, lang in zip(docs["doc_id"][held], docs["lang"][held], strict=True)]
    assert np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in got.values())


def test_texts_without_letters_and_odd_tables(spark):
    rows = [(*r, "clash") for r in [*ROWS, ROWS[0], (None, "and the", None)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "and the" if r.doc_id is None else ROWS[r.doc_id][1]
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, text or ""))) and (r.lang_pred != "und" or r.score == 0)
    assert langid.identify(docs.where("false")).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.with_language(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {0, 4, 5, 6, None}


def test_windows_cover_whole_texts():
    chars, of = langid.windows(["a" * 600, "", "é"])
    assert of.tolist() == [0, 0, 0, 2] and chars[0].tolist() == [97] * 256 and (chars[2] > 0).sum() == 88


def test_pooling_and_filters_against_plain_loops():
    net = langid.train(["abc abc", "xyz"], ["p", "q"], epochs=1)
    chars, _ = langid.windows(["abcabc"])
    hidden, embedded = langid._pooled(net, chars)
    for f in (0, 20, 47):
        width = langid.WIDTHS[f // langid._FILTERS]
        kernel = net.filters[: width * langid._EMBED, f].reshape(width, langid._EMBED)
        plain = [float((embedded[0, i : i + width] * kernel).sum()) for i in range(langid.WINDOW - langid._WIDEST + 1)]
        assert np.allclose(hidden[0, :, f], plain, atol=1e-4)


def test_filters_pool_a_few_windows_at_a_time():
    net = langid.train(["abc abc", "xyz"], ["p", "q"], epochs=1)
    chars = np.random.default_rng(5).integers(0, 256, (500, langid.WINDOW)).astype(np.uint8)
    hidden, _ = langid._pooled(net, chars)
    z = np.maximum(hidden.max(axis=1) + net.bias, 0) @ net.out + net.out_bias
    del hidden
    learner, peaks = langid._Learner(net, 0.001), []
    for work in (lambda: langid.log_probabilities(net, chars), lambda: learner.step(chars, np.arange(500) % 2)):
        tracemalloc.start()
        try:
            out = work()
            peaks.append(tracemalloc.get_traced_memory()[1])
        finally:
            tracemalloc.stop()
        assert out is None or np.allclose(out, z - np.log(np.exp(z).sum(axis=1, keepdims=True)), atol=1e-4)
    assert max(peaks) < 30 << 20, peaks


def test_without_labels_all_lettered_texts_stay(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    kept = langid.with_language(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.doc_id for r in kept.collect()} == {0, 4, 5, 6}


def test_junk_goes_and_labelled_text_stays(spark):
    docs = spark.read.parquet(SF)
    net = langid.fit_with_outside(docs)
    least = langid.calibrate(docs, net)
    assert 0 < least <= 0.5 and langid.UNKNOWN in net.languages
    kept = {r.doc_id for r in langid.with_language(docs).select("doc_id").collect()}
    lettered = {r.doc_id for r in docs.where("text rlike '[A-Za-z]'").select("doc_id").collect()}
    assert kept <= lettered and len(kept) >= 0.998 * len(lettered)
    rng = np.random.default_rng(1)
    draw = lambda alphabet, n: "".join(alphabet[int(k)] for k in rng.integers(0, len(alphabet), n))
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    junk = [draw(base64, n) for n in (150, 300, 2000, 9000)] * 3 + [c * 400 for c in "axz"] + ["ab" * 200, "qwq " * 90]
    junk += [draw([chr(c) for c in range(first, first + 500)], 300) for first in (0x4E00, 0x8000, 0x12000, 0xAC00)] + ["Это обычный русский текст о погоде и о том, что завтра будет дождь. " * 4]
    junk += [draw("0123456789abcdef", 500), " ".join(draw("bcdfghjklmnpqrstvwxz", 7) for _ in range(60))]
    stays = spark.createDataFrame([(x,) for x in junk], "text string").select(langid.in_language(net, least)("text").alias("ok")).collect()
    assert sum(not r.ok for r in stays) >= len(junk) - 1
    some = spark.createDataFrame([("the and of",), ("123",), (None,), ("",)], "text string")
    assert [r.ok for r in some.select(langid.in_language(net, least)("text").alias("ok")).collect()] == [True, False, False, False]
    strict = some.union(docs.select("text").limit(5)).select(langid.in_language(net, 1.1)("text").alias("ok")).collect()
    assert sum(r.ok for r in strict) <= 2  # short texts aside, the network's confidence decides


def test_all_labelled_rows_train_the_network(spark):
    """Rows beyond those that the network begins with change it; held-out and unlabelled ones don't, nor does their order."""
    docs = spark.read.parquet(SF).select("doc_id", "text", "lang")
    begun = lambda rows: langid.fit(rows, per_language=40)
    net, again = begun(docs.coalesce(1)), begun(docs.coalesce(1))
    assert all((a == b).all() for a, b in zip(net[1:], again[1:], strict=True))
    first = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < 400_000  # the begun ones are among these
    beyond = docs.withColumn("text", F.when(~first & ~langid.held_out(), F.lit("zq xv")).otherwise(F.col("text")))
    assert any((a != b).any() for a, b in zip(net[1:], begun(beyond.coalesce(1))[1:], strict=True))
    other = docs.withColumn("text", F.when(langid.held_out(), F.lit("zq xv")).otherwise(F.col("text")))
    assert all((a == b).all() for a, b in zip(net[1:], begun(other.coalesce(1))[1:], strict=True))


def test_threshold_counts_all_held_out_rows(spark):
    docs = spark.read.parquet(SF)
    net = langid.fit_with_outside(docs)
    texts = [r.text for r in docs.where(langid.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).collect()]
    sure = langid.confidence(net, [x for x in texts if langid.letters_of(x) >= langid.LEAST_LETTERS])
    for lost in (0.0, 0.02, 0.3):
        least = langid.calibrate(docs, net, lost)
        assert np.mean(sure < least) <= lost and (least == 0.5 or np.mean(sure < least + 1 / 4096) > lost)
