"""The registered queries of this subpackage, with DuckDB SQL where it can express them."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import stratakeep

_PACKAGE = Path(stratakeep.__file__).parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors' Python workers, once for each application.

    Rows here hold whole texts, so Arrow batches are kept to fewer rows than Spark's default of
    10,000: a batch is in the memory of the executor and of its worker at once.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    to = os.path.join(tempfile.mkdtemp(prefix="spark-"), "stratakeep.zip")
    with zipfile.ZipFile(to, "w") as z:
        for f in _PACKAGE.rglob("*.py"):
            z.write(f, f.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(to)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items' windows of ten words in every document, one row a document; null and empty texts have no words, repeated rows a row each."""
    from stratakeep.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated scores of every document, trained on labels outside the held-out fold; empty and null texts are scored by the features' zeros."""
    from stratakeep.llm.statistics import held_out
    from stratakeep.llm.toxicity import fit, score_toxicity

    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document in ascending doc_id (null first, ties by their ids), as read back from packed files; a null text is the end id alone."""
    import public_tokenizers

    from stratakeep.llm.tokenise import digest, tokenise_to_files

    return digest(tokenise_to_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 49_408))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families that each document gives; null and empty texts give none, rows of one doc_id share their findings."""
    from stratakeep.llm.licences import scan

    return scan(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each document in the mix by its source's size to the power 0.7; null sources are one source, rows alike in doc_id and source one document."""
    from stratakeep.llm.mixing import schedule

    return schedule(table(spark, sf_dir, "documents"))


def op9_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents at J >= 0.8 of four-word shingles, one row a document; texts without words are linked with nothing."""
    from stratakeep.llm.near_documents import near_documents

    return near_documents(table(spark, sf_dir, "documents"), shingle=4)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, one row a page; null and empty pages have an empty one."""
    from stratakeep.llm.pages import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the lines that are near copies of an earlier one, one row a document; every line that isn't blank is compared, null texts have none."""
    from stratakeep.llm.lines import removed_lines

    docs = table(spark, sf_dir, "documents")
    found = removed_lines(docs, least_bytes=1).select(F.col("doc_id").alias("d"), "n_compared", "removed")
    lines = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    out = docs.select("doc_id", lines.alias("n_lines")).join(found, F.col("doc_id") == F.col("d"), "left")
    removed = F.coalesce("removed", F.array().cast("array<long>"))
    return out.select("doc_id", "n_lines", F.coalesce("n_compared", F.lit(0)).cast("long").alias("n_compared"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed_lines"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics, base rules and the learned decision list's verdict, one row a document; a null text has no words and fails."""
    from stratakeep.llm.decision_list import fit, quality_rules

    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit(docs, table(spark, sf_dir, "labels")))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by the additive model, trained on labels outside the held-out fold; empty and null texts are scored by the features' zeros."""
    from stratakeep.llm.additive_model import fit_quality, score_quality
    from stratakeep.llm.statistics import held_out

    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best 2000 phrases, by phrases.collocations."""
    from stratakeep.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded by sentence_pieces, one row a document; a null text is empty."""
    import public_tokenizers

    from stratakeep.llm.sentence_pieces import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut and arranged by fill_middle and restored from that, one row a document; a null text is empty."""
    from stratakeep.llm.fill_middle import fill_in_middle, restore

    shown = restore(fill_in_middle(table(spark, sf_dir, "documents")), with_text=False)
    return shown.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.col("text_sha256").alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_main_text": op2_main_text,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_token_files": op6_token_files,
    "op7_licence_scan": op7_licence_scan,
    "op8_mix_sources": op8_mix_sources,
    "op9_near_documents": op9_near_documents,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_collocations": op11_collocations,
    "op12_sentence_pieces": op12_sentence_pieces,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP1_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP9_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op1_decontaminate": f"""
WITH items AS (SELECT item_id, {_OP1_WORDS} AS w FROM benchmark),
docs AS (SELECT doc_id, {_OP1_WORDS} AS w FROM documents),
wanted AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT n FROM wanted),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)
),
hits AS (SELECT doc_id, item_id, i, n FROM grams JOIN wanted USING (n, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
""",
    "op9_near_documents": f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_OP9_WORDS} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)
),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_of AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
       doc_id <= coalesce(m, doc_id) AS kept
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)
""",
    "op11_collocations": f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents
),
split AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k)
),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
cuts AS (
  SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS x, array_to_string(w[c + 1:k], ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS c FROM candidates)
),
scores AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, c, x.a AS l, y.a AS r, CAST((2000000::HUGEINT * cuts.a) // (x.a::HUGEINT + y.a) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.x JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.y
),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
parts AS (
  SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - n + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS n FROM candidates)) GROUP BY ALL
),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN parts USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
    "op13_fill_in_middle": r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents
),
drawn AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM docs
),
cut AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j FROM drawn
),
parts AS (
  SELECT *, array_to_string(u[1:i], '') AS p, array_to_string(u[i + 1:j], '') AS m, array_to_string(u[j + 1:n], '') AS s FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
""",
}
