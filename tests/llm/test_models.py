from __future__ import annotations

import itertools
import math
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidewire.llm import language, quality
from tidewire.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op7_language"](spark, SF).join(truth, "doc_id").collect()
    assert len(got) == truth.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.97 * len(held)
    clear = [r for r in got if not r["rejected"]]
    assert len(clear) > 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(spark, table, odd_rows):
    taught = [(100 + i, t, lang, None) for i, (t, lang) in enumerate([("the one and the two", "en"), ("der eine und die", "de"), (None, "fr"), ("12", "fr"), ("le la", None)])]
    model = language.train(table([*taught, *taught[:1]]))
    assert model.languages == ("de", "en")
    docs = table(odd_rows)
    got = docs.withColumn("r", language.identify(docs, "text", model)).select("doc_id", "text", "r.*").collect()
    assert len(got) == len(odd_rows)
    for r in got:
        letters = any(map(str.isalpha, r["text"] or ""))
        assert (r["lang"] == "und") == (not letters) and 0 <= r["score"] <= 1
    empty = language.train(table([]))
    assert empty.languages == ()
    r = docs.select(language.identify(docs, "text", empty).alias("r")).select("r.*").distinct().collect()
    assert [(x["lang"], x["score"]) for x in r] == [("und", 0.0)]
    none = table([])
    assert none.select(language.identify(none, "text", model)).count() == 0
    small = language.train(table(taught), max_languages=1, dictionary_bytes=20)
    assert small.languages == ("de", "en") and small.dictionaries == (b" der e", b" the o")


def test_languages_beyond_the_bound_share_it(table):
    names = [f"l{i:02}" for i in range(12)]
    rows = [(i, f"{chr(97 + i % 12) * 3} word{i // 12}", names[i % 12], None) for i in range(480)]
    whole = language.train(table(rows))
    less = language.train(table(rows), max_languages=4, texts_per_language=6, dictionary_bytes=60)
    assert whole.languages == less.languages == tuple(names)
    assert all(0 < len(b) <= 20 for b in less.dictionaries)
    assert all(b.split()[0] == bytes([97 + i]) * 3 for i, b in enumerate(less.dictionaries))


@pytest.mark.parametrize("size", [1, 63, 64, 65, 1023, 1024, 1087, 1088, 1089, 5000])
def test_pieces_lose_nothing_and_none_is_short(size):
    body = bytes(i % 251 for i in range(size))
    pieces = language.pieces_of(body)
    if size < language.SHORT:
        assert pieces == [body * language.COPIES]
    else:
        assert b"".join(pieces) == body and min(map(len, pieces)) >= language.SHORT
        assert max(map(len, pieces)) < language.PIECE + language.SHORT


def plain_language(text, taught):
    """Language, score and margin by one zstandard call per piece and language."""
    words = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip()
    if not any(c.isalpha() for c in words):
        return "und", 0.0, 0.0
    body, pieces = f" {words} ".encode(), []
    if len(body) < 64:
        pieces = [body * 8]
    while body and not pieces or len(body) >= 1024 + 64:
        if len(body) < 1024 + 64:
            pieces.append(body)
            break
        pieces.append(body[:1024])
        body = body[1024:]
        if len(body) < 1024 + 64:
            pieces.append(body)
    sizes = {}
    for name, sample in taught.items():
        how = zstandard.ZstdCompressionParameters.from_level(
            6, source_size=1024, dict_size=len(sample), min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        book = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        book.precompute_compress(compression_params=how)
        pack = zstandard.ZstdCompressor(compression_params=how, dict_data=book)
        sizes[name] = sum(len(pack.compress(p)) for p in pieces)
    (best, name), *rest = sorted((n, name) for name, n in sizes.items())
    score = 1 / sum(math.exp(-min(700.0, max(0.0, (n - best) / 4))) for n in sizes.values())
    return name, score, (rest[0][0] - best) / rest[0][0] if rest else 1.0


def test_language_query_against_plain_compression(spark, tmp_path, odd_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120")
    odd = spark.createDataFrame([(10_000 + i, r[1], r[2]) for i, r in enumerate(odd_rows)], "doc_id long, text string, lang string")
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(odd, allowMissingColumns=True)
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    held = rows.collect()

    # The sample by its rule: of a language's rows, per bucket of the hash the one of least hash.
    hashed = {r["doc_id"]: r["h"] for r in rows.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    picks = {}
    for r in held:
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None and r["text"] is not None:
            h = hashed[r["doc_id"]]
            key = r["lang"], h % 256
            picks[key] = min(picks.get(key, (h, r["text"])), (h, r["text"]))
    taught = {}
    for (lang, _), (_, text) in sorted(picks.items(), key=lambda x: (x[0][0], x[1][0])):
        taught[lang] = taught.get(lang, b"") + language.folded(text[:4000])[:4000]
    taught = {k: v[:400_000] for k, v in taught.items() if v}

    got = QUERIES["op7_language"](spark, str(tmp_path)).collect()
    want = {r["doc_id"]: plain_language(r["text"], taught) for r in held}
    assert len(got) == len(held)
    for r in got:
        name, score, _ = want[r["doc_id"]]
        assert r["lang_pred"] == name and r["score"] == pytest.approx(score)


def test_lines_of_the_sample_reach_over_the_whole_text():
    assert quality.spread_lines(500, 500).tolist() == list(range(500))
    for n in (501, 737, 40_000):
        lines = quality.spread_lines(n, 500)
        assert len(lines) <= 500 and lines[0] == 0 and lines[-1] == n - 1
        assert np.diff(lines).max() <= n / 15


def test_language_of_short_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    scorer = language.Scorer(language.train(docs.where(~fold)))
    rows = docs.where(fold).where("text IS NOT NULL").orderBy("doc_id").collect()
    texts = []
    for r in rows:
        words = language.folded(r["text"]).decode().split()
        texts += [(" ".join(words[a : a + n]), r["lang"]) for a, n in ((3, 3), (5, 4), (9, 5)) if len(words) > 20]
    assert len(texts) > 300
    found = [(scorer.score(t), lang) for t, lang in texts if len(language.folded(t)) < 30]
    assert len(found) > 200
    clear = [(f[0], lang) for f, lang in found if f[2] >= language.NARROW]
    assert len(clear) > 0.9 * len(found)
    assert sum(a == b for a, b in clear) > 0.95 * len(clear)
    for text in ("le petit chat noir", "the little cat and the dog", "der kleine und die gute"):
        sizes = scorer.sizes(language.folded(text))
        assert len(set(sizes)) > 1
    # A short end of a long text counts too.
    long = language.folded("the one of the two " * 60)[: language.PIECE]
    assert len(scorer.sizes(long + b" und der die das")) == len(scorer.languages)
    ends = np.subtract(scorer.sizes(long + b" und der die das "), scorer.sizes(long))
    assert len(set(ends)) > 1


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    got = QUERIES["op5_quality"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) > 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_quality_of_odd_rows(spark, table, odd_rows):
    docs = table(odd_rows)
    labels = spark.createDataFrame(
        [(1, 1), (7, 0), (7, 0), (8, 1), (4, None), (None, 1), (777, 0)], "doc_id bigint, quality int"
    )
    model = quality.train(docs, labels)
    scored, name = quality.score(docs, model)
    assert name == "quality_" and scored.columns == [*docs.columns, name]
    for r in scored.collect():
        assert 0 <= r[name]["score"] <= 1
        assert len(r[name]["lines"]) == len((r["text"] or "").encode().split(b"\n"))
    for none in (labels.where("quality = 1"), labels.limit(0)):
        constant, name = quality.score(docs, quality.train(docs, none))
        assert {r[name]["score"] > 0.5 for r in constant.collect()} == {True}
    assert quality.score(table([]), model)[0].count() == 0


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(3)
    sizes = np.array([3, 1, 5, 2])
    odds, transition = rng.normal(size=11), rng.normal(size=(2, 2))
    good, pairs, norm = quality.forward_backward(odds, sizes, transition)
    at = 0
    for d, n in enumerate(sizes):
        total, marginal, second = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            value = np.exp(sum(odds[at + i] * y for i, y in enumerate(path)) + sum(transition[p] for p in zip(path, path[1:])))
            total += value
            marginal += value * np.array(path)
            for i in range(1, n):
                second[i, path[i - 1], path[i]] += value
        assert np.allclose(good[at : at + n], marginal / total)
        assert np.allclose(pairs[at : at + n], second / total)
        assert np.isclose(norm[d], np.log(total))
        at += n


def test_the_label_of_a_line_depends_on_its_neighbours():
    good = np.array([0.2, 0.2, 0.2])
    transition = np.array([[2.0, -2.0], [-2.0, 2.0]])
    alone = quality.forward_backward(good, np.array([1, 1, 1]), transition)[0]
    near_bad = quality.forward_backward(np.array([-9.0, 0.2, -9.0]), np.array([3]), transition)[0]
    assert alone[1] > 0.5 > near_bad[1]


def test_scores_do_not_use_labels(spark, table, odd_rows):
    model = quality.train(table(odd_rows), spark.createDataFrame([(1, 1), (7, 0)], "doc_id bigint, quality int"))
    docs = table(odd_rows)
    other = docs.select(*[F.lit(None).cast(t).alias(c) if c != "text" else "text" for c, t in docs.dtypes])
    a = [r[-1]["score"] for r in quality.score(docs, model)[0].collect()]
    b = [r[-1]["score"] for r in quality.score(other, model)[0].collect()]
    assert sorted(a) == sorted(b)
