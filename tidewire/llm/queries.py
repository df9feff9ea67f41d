"""The registered queries over the corpus tables and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import (
    decontaminate,
    exact_dedup,
    language,
    licenses,
    manifest,
    mixing,
    near_dedup,
    pii,
    quality,
    substring_dedup,
    token_counts,
    token_files,
    variants,
)
from tidewire.session import scratch_path, use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = "byte_bpe_50k.json"
TOKEN_LIMIT = 1024


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(use_utc(spark), sf_dir.rstrip("/"))

    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in the mix of all sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    planned, _ = mixing.plan_copies(docs)
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return planned.select("doc_id", "size", "source_size", "target", taken, "copies")


ORACLES["op1_source_mix"] = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, rk,
         CAST(CASE rk % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS DOUBLE) AS weight
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM by_source)
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(CAST(sum(source_size * 3) OVER w AS DOUBLE), 0.0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0)) AS own_level
  FROM ranked
  WINDOW w AS (ORDER BY CAST(source_size AS DOUBLE) * 3.0 / weight, rk
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
         least(CAST(source_size AS DOUBLE) * 3.0, max(own_level) OVER () * weight) AS target
  FROM levels
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0) ELSE 0.0 END AS rate,
         CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT)
           / 4503599627370496.0 AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies
FROM (SELECT *, CAST(floor(rate) AS BIGINT)
                + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM rated)
"""


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a benchmark window."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, name = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    leaks = F.col(name)
    return found.select(
        "doc_id",
        leaks["n_words"].alias("n_words"),
        leaks["n_hit"].alias("n_hit"),
        F.size(leaks["item_ids"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(leaks["item_ids"], ","), 256).alias("items_sha256"),
        (leaks["n_hit"] > 0).alias("contaminated"),
    )


_WORDS = (
    r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLES["op2_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, coalesce({_WORDS}, []) AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
         array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n)
),
hits AS (SELECT doc_id, item_id, p.s, p.n FROM places p JOIN windows USING (n, win)),
words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM hits) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits WHERE item_id IS NOT NULL)
  GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near duplicates of every document."""
    return near_dedup.find_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op3_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + least(len(w), 5) - 1], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * n_both >= 75 * (p.n + q.n - n_both)
), either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n
  UNION
  SELECT r.a, e.b FROM reach r JOIN either e ON r.b = e.a
), least_id AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id,
       d.doc_id = coalesce(c, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least_id ON a = d.doc_id
"""


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of identical texts of every document."""
    return exact_dedup.find_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op4_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; one fold in three is not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out)
    scored, name = quality.score(docs, quality.train(docs, labels))
    value = F.col(name)["score"]
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        value.alias("score"),
        F.when(value >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query
def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the files."""
    path = scratch_path(spark, "token-ids")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    token_files.write_token_files(docs, public_tokenizers.path(BYTE_BPE), path)
    return token_files.read_token_files(spark, path)


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; one fold in four is not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.train(docs.where(~fold))
    found = docs.select("doc_id", fold.alias("held_out"), language.identify(docs, "text", model).alias("r"))
    return found.select(
        "doc_id",
        "held_out",
        F.col("r.lang").alias("lang_pred"),
        F.col("r.score").alias("score"),
        language.rejected(F.col("r")).alias("rejected"),
    )


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document outside passages that an earlier document has."""
    found = substring_dedup.find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.drop("spans")


ORACLES["op8_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(w[s : s + 12], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM w WHERE len(w) >= 13)
), owner AS (SELECT win, min(doc_id) AS least FROM win GROUP BY win),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS k
  FROM win JOIN owner USING (win) WHERE least < doc_id
), words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM w),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text
  FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, counted through a cache that starts empty."""
    counted = token_counts.count_tokens(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        public_tokenizers.path(BYTE_BPE),
        scratch_path(spark, "token-cache"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[f"n_{k}" for k in pii.KINDS[:4]],
        F.sha2("base", 256).alias("base_sha256"),
        "spans",
    )


@query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


_TEMPLATES = ", ".join(
    f"({i}, '{t.label}', '{t.words}', {str(t.exact).lower()})"
    for i, t in enumerate(licenses.TEMPLATES)
)

ORACLES["op11_license_scan"] = rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
t AS (
  SELECT t, label, string_split(words, ' ') AS w, exact
  FROM (VALUES {_TEMPLATES}) AS v(t, label, words, exact)
), grams AS (
  SELECT t, label, exact, len(w) AS n, p, w[p + 1] AS a, w[p + 2] AS b
  FROM (SELECT *, unnest(range(0, len(w) - 1)) AS p FROM t)
), hits AS (
  SELECT doc_id, t, label, exact, n, g.p, d.p - g.p AS diagonal
  FROM (SELECT doc_id, p, w[p + 1] AS a, w[p + 2] AS b
        FROM (SELECT doc_id, w, unnest(range(0, len(w) - 1)) AS p FROM d)) d
  JOIN grams g USING (a, b)
), places AS (
  SELECT doc_id, label, diagonal FROM hits WHERE exact
  GROUP BY doc_id, t, label, n, diagonal HAVING count(DISTINCT p) = n - 1
), near AS (
  SELECT DISTINCT x.doc_id, x.t, x.label, x.n, x.diagonal, y.p
  FROM (SELECT DISTINCT doc_id, t, label, n, diagonal FROM hits WHERE NOT exact) x
  JOIN hits y ON x.doc_id = y.doc_id AND x.t = y.t AND y.diagonal BETWEEN x.diagonal AND x.diagonal + 3
), notices AS (
  SELECT doc_id, label, count(DISTINCT k) / n AS coverage
  FROM (SELECT *, unnest([p, p + 1]) AS k FROM near) GROUP BY doc_id, t, label, n, diagonal
  HAVING count(DISTINCT k) / n >= 0.8
), base AS (
  SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM places GROUP BY doc_id
), every AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM (SELECT doc_id, label, 1.0 AS coverage FROM places UNION ALL SELECT * FROM notices) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
       coalesce(CAST(score AS DOUBLE), 0.0) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)
"""


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and tamper check of every document."""
    docs = table(spark, sf_dir, "documents").select(*manifest.FIELDS)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest.build(docs, changed={"text": cut})


#: crc32 of the bytes in list ``bytes``, by the table of the polynomial's remainders.
_CRC_TABLE = """crc AS (
  SELECT list(list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z:
              xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY b) AS tbl
  FROM (SELECT unnest(range(0, 256)) AS b)
)"""


def _crc32(text: str) -> str:
    """DuckDB expression of the unsigned crc32 of a text's UTF-8 bytes; needs ``crc`` joined."""
    digits = f"hex(encode({text}))"
    one = f"CAST('0x' || substr({digits}, i, 2) AS BIGINT)"
    return (
        f"xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len({digits}), 2), lambda i: {one})), "
        "lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295)"
    )


def _field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(f) for f in ('doc_id', 'source', 'lang', 'n_chars', text))})"


ORACLES["op12_merkle_manifest"] = rf"""
WITH RECURSIVE {_CRC_TABLE},
leaves AS (
  SELECT doc_id, coalesce('s' || source, '') AS tree, source, {_leaf('text')} AS leaf,
         CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 2 = 0
              THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS other,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos
  FROM documents, crc
), nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 3
), subroots AS (
  SELECT tree, digest, level AS height, row_number() OVER (ORDER BY tree) - 1 AS pos
  FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, pos, digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM upper WHERE n > 1 GROUP BY level, pos // 3
), top AS (SELECT digest AS root, level AS height FROM upper WHERE n = 1),
every AS (
  SELECT tree, level, pos, digest FROM nodes WHERE n > 1
  UNION ALL SELECT s.tree, s.height + u.level, u.pos, u.digest FROM subroots s, upper u WHERE u.n > 1
), climb AS (
  SELECT l.doc_id, l.tree, 0 AS level, CASE WHEN s.height = 0 THEN s.pos ELSE l.pos END AS pos, l.other AS value,
         '' AS proof, s.pos AS tree_pos, s.height, s.height + t.height AS total
  FROM leaves l JOIN subroots s USING (tree), top t
  UNION ALL
  SELECT c.doc_id, c.tree, c.level + 1,
         CASE WHEN c.level + 1 = any_value(c.height) THEN any_value(c.tree_pos) ELSE any_value(c.pos) // 3 END,
         sha256(string_agg(CASE WHEN e.pos = c.pos THEN c.value ELSE e.digest END, '' ORDER BY e.pos)),
         any_value(c.proof) || coalesce(string_agg(CASE WHEN e.pos <> c.pos THEN e.digest END, '' ORDER BY e.pos), ''),
         any_value(c.tree_pos), any_value(c.height), any_value(c.total)
  FROM climb c JOIN every e ON e.tree = c.tree AND e.level = c.level AND e.pos // 3 = c.pos // 3
  WHERE c.level < c.total GROUP BY c.doc_id, c.tree, c.level
)
SELECT l.doc_id, l.leaf, s.digest AS subroot, root, sha256(proof) AS proof_sha256,
       value AS folded_root, value = root AS verified
FROM climb c JOIN leaves l USING (doc_id) JOIN subroots s ON s.tree = l.tree, top
WHERE c.level = c.total
"""


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of the documents."""
    return variants.find_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op13_spelling_variants"] = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL
), hashed AS (
  SELECT run, n, {_crc32("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)")} AS h FROM runs, crc
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 97 = 0
               THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), less AS (
  SELECT word, n, length(word) AS l, k, substr(word, 1, k - 1) || substr(word, k + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)
), pairs AS (
  SELECT a.word AS a, b.word AS b, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.l = b.l AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), ranked AS (
  SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near,
         row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place FROM pairs
), best AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN r.n >= 2 * w.n THEN b END AS form, CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.a = w.word AND place = 1
), steps AS (
  SELECT word, word AS here, 0 AS step FROM best
  UNION ALL
  SELECT s.word, b.form, step + 1 FROM steps s JOIN best b ON b.word = s.here WHERE b.form IS NOT NULL
), roots AS (SELECT word, arg_max(here, step) AS root FROM steps GROUP BY word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM best JOIN roots USING (word)
"""
