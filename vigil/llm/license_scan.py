"""License scans by diagonal voting. DataFrame functions only.

All rolling word k-gram hashes of a text are joined with the positions of the templates' k-grams; a hit votes for its offset
diagonal (place in the text less place in the template). Neighbouring diagonals are merged, so that a few words more or less
do no harm, and the span is verified by the share of the template's k-grams (compared as words, not as hashes) that it holds.
Short templates vote with pairs of words, long ones with runs of LONG words, which common pairs of words can't flood.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .license_texts import NOTICES, TEXTS
from .url_filter import LOWER, UPPER

SHORT, LONG = 2, 4
#: Templates of more words vote with runs of LONG words.
SHORT_WORDS = 10
SHARE = 0.6
#: Diagonals up to this far apart are one span, of short and of long templates.
NEAR, NEAR_LONG = 2, 8
#: Templates are few and written here or checked to have no more k-grams than this, so that they can be broadcast.
MOST_GRAMS = 500_000
#: First words of the templates' k-grams that a text's are compared with before they are hashed; with more of them all are hashed.
MOST_FIRST = 5000
OTHER = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Template:
    """base: a phrase whose every place counts and must stand word for word."""

    label: str
    text: str
    base: bool = False

    def words(self) -> list[str]:
        return [w for w in re.split(OTHER, self.text.translate(str.maketrans(UPPER, LOWER))) if w]

    def k(self) -> int:
        return SHORT if self.base or len(self.words()) <= SHORT_WORDS else LONG

    def grams(self) -> list[str]:
        w = self.words()
        return [" ".join(w[i : i + self.k()]) for i in range(len(w) - self.k() + 1)]


BASE = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)
METHOD = tuple(Template(*x) for x in [*NOTICES.items(), *TEXTS.items()])


def lowered(text: Column) -> Column:
    """A-Z lower-cased, nothing else; lower() does that on ASCII text and is faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.filter(F.split(lowered(text), OTHER), lambda w: w != "")


def _grams(w: Column, k: int, first: list[str]) -> Column:
    """(pos, gram) of each k-gram that begins with one of some words (of all if there are too many to name)."""
    at = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
    if len(first) <= MOST_FIRST:
        at = F.filter(at, lambda i: F.get(w, i).isin(first))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.concat_ws(" ", *[F.get(w, i + j) for j in range(k)]).alias("gram")))


def rows_of(given: tuple[Template, ...]) -> list[tuple]:
    """(gram, template, label, base, size, near, position) of all templates."""
    out = []
    for n, t in enumerate(given):
        grams = t.grams()
        if not grams or (t.base and len(t.words()) < SHORT):
            raise ValueError(f"a template needs {SHORT} words: {t.text}")
        out += [(g, n, t.label, t.base, len(grams), NEAR if t.k() == SHORT else NEAR_LONG, i) for i, g in enumerate(grams)]
    if len(out) > MOST_GRAMS:
        raise ValueError("too many templates to broadcast")
    return out


def templates(spark: SparkSession, given: tuple[Template, ...]) -> DataFrame:
    """The templates' k-grams, and one of no words that every text has."""
    rows = [("", -1, "", False, 0, 0, -1), *rows_of(given)]
    return spark.createDataFrame(rows, "t_gram string, t int, label string, base boolean, size int, near int, t_pos int").withColumn("h", F.xxhash64("t_gram"))


def scan(docs: DataFrame, given: tuple[Template, ...] = BASE + METHOD, share: float = SHARE) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans.

    Null and empty texts have no words and no labels (empty strings). Rows that repeat repeat; a null doc_id stays null; other
    columns are not used; an empty table gives an empty result. score: the largest share of a template's k-grams found in one
    span, 0 without any.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    key = ["doc_id", "k1", "k2", "n_words"]  # a row is known by its id and two hashes of its text
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("k1"), F.hash(text, "doc_id").alias("k2"), words(text).alias("w"))
    none = F.array(F.struct(F.lit(-1).alias("pos"), F.lit("").alias("gram")))
    firsts = {k: sorted({g.split(" ")[0] for t in given if t.k() == k for g in t.grams()}) for k in (SHORT, LONG)}
    every = F.concat(none, *[_grams(F.col("w"), k, first) for k, first in firsts.items() if first])
    grams = rows.select("doc_id", "k1", "k2", F.size("w").cast("bigint").alias("n_words"), F.explode(every).alias("g"))
    grams = grams.select(*key, "g.pos", "g.gram", F.xxhash64("g.gram").alias("h"))
    own = ["t", "label", "base", "size", "near"]
    hits = grams.join(F.broadcast(templates(spark, given)), "h").where("gram = t_gram").select(*key, *own, "t_pos", (F.col("pos") - F.col("t_pos")).alias("diagonal"))
    votes = hits.repartition("k1", "k2").groupBy(*key, *own, "diagonal").agg(F.collect_set("t_pos").alias("found"), F.count("*").alias("rows"))
    # neighbouring diagonals of a template are one span; base phrases stand on one diagonal
    w = Window.partitionBy(*key, *own).orderBy("diagonal")
    far = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(w) > F.col("near"))
    votes = votes.withColumn("new", F.coalesce(far, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(w))
    spans = votes.groupBy(*key, *own, "span").agg(
        (F.size(F.array_distinct(F.flatten(F.collect_list("found")))) / F.greatest("size", F.lit(1))).alias("share"), F.min("diagonal").alias("at"), F.max("rows").alias("rows")
    )
    real, base = F.col("t") >= 0, F.col("base") & (F.col("share") == 1)
    good = real & (F.col("share") >= F.when(F.col("base"), 1.0).otherwise(share))
    out = spans.groupBy(*key).agg(
        F.sum(base.cast("bigint")).alias("n_base"), F.min(F.when(base, F.col("at"))).cast("bigint").alias("first_word"), F.max(F.when(base, F.col("at"))).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set(F.when(good, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(real, F.col("share"))), F.lit(0.0)).alias("score"), F.sum(good.cast("bigint")).alias("n_spans"), F.max(F.when(~real, F.col("rows"))).alias("copies"),
    )
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("k1", "k2", "copies", "__copy")


def sql(given: tuple[Template, ...] = BASE + METHOD, share: float = SHARE) -> str:
    """DuckDB SQL with the same rows over documents."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(g)}, {t}, {quote(label)}, {base}, {size}, {near}, {pos})" for g, t, label, base, size, near, pos in rows_of(given))
    split = f"regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{OTHER}')"
    gram = lambda k: f"SELECT r, p AS pos, array_to_string(w[p + 1:p + {k}], ' ') AS gram FROM (SELECT r, w, unnest(range(len(w) - {k - 1})) AS p FROM d)"
    return f"""
WITH t(gram, t, label, base, size, near, t_pos) AS (VALUES {values}),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter({split}, lambda x: x <> '') AS w FROM documents),
hits AS MATERIALIZED (SELECT r, t, label, base, size, near, t_pos, pos - t_pos AS diagonal FROM ({gram(SHORT)} UNION ALL {gram(LONG)}) JOIN t USING (gram)),
steps AS (SELECT *, base OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, t ORDER BY diagonal) > near, true) AS new
  FROM (SELECT DISTINCT r, t, base, near, diagonal FROM hits)),
span AS (SELECT r, t, diagonal, sum(new::INT) OVER (PARTITION BY r, t ORDER BY diagonal) AS span FROM steps),
spans AS (SELECT r, t, any_value(label) AS label, any_value(base) AS base, count(DISTINCT t_pos) / any_value(size) AS share, min(diagonal) AS place
  FROM hits JOIN span USING (r, t, diagonal) GROUP BY r, t, span),
per AS (SELECT r, count(*) FILTER (base AND share = 1) AS n_base, min(place) FILTER (base AND share = 1) AS first_word, max(place) FILTER (base AND share = 1) AS last_word,
  list_sort(list(DISTINCT label) FILTER (base AND share = 1)) AS b, list_sort(list(DISTINCT label) FILTER (share >= CASE WHEN base THEN 1 ELSE {share} END)) AS l,
  max(share) AS score, count(*) FILTER (share >= CASE WHEN base THEN 1 ELSE {share} END) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(b, ','), '') AS base_labels,
  coalesce(array_to_string(l, ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN per USING (r)"""
