"""Queries over this subpackage's operators, with the parameters meant for production."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.llm import automata, chat, licences, minmax, mixing, piece_bpe, quality, resample, secrets, suffix_radix, toxicity, upsert, vafile
from strandlab.llm.shared import table


def model_file(name: str = "piece_bpe_32k.model") -> str:
    """A public tokenizer's file; STRANDLAB_TOKENIZERS names another folder."""
    folder = os.environ.get("STRANDLAB_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"), licences.known(spark))


def op2_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"))


def op3_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vafile.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "threshold", "toxic")


def op5_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).drop("copies")


def op6_suffix_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_radix.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op8_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.judged(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = F.col("ids").cast("array<string>")
    return piece_bpe.encode(docs, model_file()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids, ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op10_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = automata.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_bucket_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: What the changes set.
CLIENT_COLUMNS = ["source", "segment", "city", "balance"]


def op12_vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clients' files after their changes; the folder stays."""
    clients, changes = table(spark, sf_dir, "clients"), table(spark, sf_dir, "client_changes")
    crc = lambda c: F.crc32(F.col(c).cast("string"))
    most = 1 + clients.count() // 1500
    folder, schema, key = upsert.new_folder(spark, "clients"), clients.schema, "client_id"
    upsert.create(clients.filter(crc(key) % 7 > 3), key, folder, most)
    before = upsert.files(spark, folder, schema, key)
    hashes = [zlib.crc32(str(f.first).encode()) % 10 for f in before]
    best = F.max(F.struct("seq", "change_id", "op", *CLIENT_COLUMNS)).alias("w")
    won = changes.filter("client_id is not null").groupBy(key).agg(best).select(key, "w.*")
    won = won.withColumn("h", F.element_at(F.array(*map(F.lit, hashes)), upsert.home(before)(key) + 1) if before else F.lit(10)).filter("h <= 7")
    gone = (F.col("op") == "D") | (crc("change_id") % 8 < F.col("h"))
    staged = upsert.stage(spark, folder, schema, key, won, CLIENT_COLUMNS, F.coalesce(F.col("op") == "D", F.lit(False)) | F.coalesce(gone, F.lit(False)), before)
    upsert.compact(staged, spark, most)
    after = upsert.files(spark, folder, schema, key)
    cents = lambda cell: F.coalesce(F.floor(100 * cell("balance") + 0.5), F.lit(0))
    names = lambda cell: F.crc32(F.concat_ws("|", *(F.coalesce(cell(c), F.lit("")) for c in ("source", "segment", "city"))))
    told = upsert.described(spark, folder, schema, key, after, cents, names)
    old = {f.path for f in before}
    paths = spark.createDataFrame([(k, f.path, f.path not in old) for k, f in enumerate(after)], "__file int, path string, rewritten boolean")
    return told.join(F.broadcast(paths), "__file").select("first_id", "n_rows", "cents", "rows_crc", "ids_sha256", F.lit(",".join(schema.names)).alias("columns"), "path", "rewritten")


def op13_secret_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*secrets.BASE))
    return out.select("doc_id", *map(count, secrets.BASE), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("found")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_digests, op2_minmax_dedup, op3_va_file, op4_toxicity, op5_fair_mix, op6_suffix_radix, op7_chat_snapshots, op8_decision_list, op9_piece_codec, op10_automata, op11_bucket_resample, op12_vector_upsert, op13_secret_index)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_digests": licences.SCAN_SQL, "op5_fair_mix": mixing.TAKEN_SQL, "op7_chat_snapshots": chat.FORMATTED_SQL, "op13_secret_index": secrets.SQL}
