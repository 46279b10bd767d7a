"""Queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import ball_tree, decontaminate, langid, lattice, licenses, mixing, ngram_join, periodic, quality, secret_scan, sharding, token_counts, toxicity
from quarry.llm.sql import OP2_SQL, OP8_SQL, OP9_SQL, OP10_SQL, OP12_SQL
from quarry.llm.tables import is_held_out, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = ["low_quality", "toxic"]
    models = toxicity.fit_toxicity(docs, labels, chain)
    scored = toxicity.score_toxicity(docs, models, chain)
    return scored.select(
        "doc_id", is_held_out().alias("held_out"), "p_low_quality", "p_toxic", (F.col("p_toxic") >= toxicity.THRESHOLD).alias("toxic")
    )


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lattice_duplicates(table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify_languages(docs, langid.fit_languages(docs))
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", "predicted")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = licenses.fit_licenses(licenses.background(docs, "text"))
    found = licenses.scan_licenses(docs, model)
    return found.select(
        "doc_id", "license", "n_confirmed", F.size("paragraphs").cast("long").alias("n_flagged"), F.coalesce(F.array_max("paragraphs.probability"), F.lit(0.0)).alias("score")
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.withColumn("__size", sharding.record_size(F.col("text")))
    placed = sharding.shuffle_into_shards(sized, 40, size_col="__size", hash_cols=["doc_id", "text"])
    written = sharding.written_shards(placed.drop("__size"))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    placed = written.withColumns({"size": sharding.record_size(F.col("text")), "text_crc32": F.crc32(text)})
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    weights = mixing.weights_by_size(docs, "source", power=0.5)
    return mixing.mix_sources(docs, weights)


def planted(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words of a document, or of one in ten by its id: words from some place on
    repeat with a period. A row without an id keeps its words."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), edit=planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("rest"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.withColumns({"best": best, "lines": lines})
    length, period = F.col("best.length"), -F.col("best.rest")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.back")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("(1000 * best.length) div -best.rest").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan_secrets(docs, secret_scan.word_ranks(docs))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in secret_scan.KINDS],
        F.sha2(joined(of("assign", "access", "hex")).cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_lattice": op2_lattice,
        "op3_language_id": op3_language_id,
        "op4_token_counts": op4_token_counts,
        "op5_quality": op5_quality,
        "op6_licenses": op6_licenses,
        "op7_sharding": op7_sharding,
        "op8_ngram_join": op8_ngram_join,
        "op9_decontaminate": op9_decontaminate,
        "op10_mixing": op10_mixing,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_ranked_search": op12_ranked_search,
        "op13_secret_scan": op13_secret_scan,
    }


def oracle_sql() -> dict:
    return {"op2_lattice": OP2_SQL, "op8_ngram_join": OP8_SQL, "op9_decontaminate": OP9_SQL, "op10_mixing": OP10_SQL, "op12_ranked_search": OP12_SQL}
