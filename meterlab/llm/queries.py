"""The queries of the ten operators, with their production settings, over whole tables."""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import functions as F

from . import twins
from .collocations import collocations
from .ctph import fingerprint_documents
from .divergence import source_divergence
from .huffman import read_tokens, write_tokens
from .jaccard import similar_groups
from .langid import held_out, identify
from .linefreq import line_frequency
from .mixing import plan, sized
from .packing import pack
from .pieces import decode, encode
from .pulearn import classify
from .pulearn import train as train_quality
from .registry import query
from .sharding import shard
from .stages import keep
from .substrings import remove_repeats


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@cache
def vocabulary(name: str) -> str:
    """The JSON text of a public tokenizer; it travels with the job."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text()


@cache
def piece_model(name: str) -> bytes:
    """The model file of a public piece tokenizer; it travels with the job."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


@query("op1_packing")
def op1(spark, d):
    return pack(table(spark, d, "documents"), vocabulary("word_bpe_49k.json"))


@query("op2_sharding", sql=twins.OP2)
def op2(spark, d):
    return shard(table(spark, d, "documents"), 24)


@query("op3_line_frequency", sql=twins.OP3)
def op3(spark, d):
    """Lines in three documents and 5 % of the host's, or in more than 50 documents of a host of any size."""
    return line_frequency(table(spark, d, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left")


@query("op3_line_frequency_large_hosts", sql=twins.OP3_LARGE_HOSTS)
def op3_large_hosts(spark, d):
    """Only lines in more than 50 documents and 5 % of the host's: hosts of up to 50 documents keep all lines."""
    return line_frequency(table(spark, d, "documents"), min_docs=50, always=None).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left")


@query("op7_mixing", sql=twins.OP7)
def op7(spark, d):
    sizes, _ = keep(sized(table(spark, d, "documents")))
    return plan(sizes).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query("op8_token_file")
def op8(spark, d):
    path, _ = write_tokens(table(spark, d, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)
    return read_tokens(spark, path, with_ids=False)


@query("op9_fingerprints")
def op9(spark, d):
    return fingerprint_documents(table(spark, d, "documents"))


@query("op4_substring_dedup", sql=twins.OP4)
def op4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op10_ngram_join", sql=twins.OP10)
def op10(spark, d):
    return similar_groups(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


@query("op5_language")
def op5(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    found = identify(docs, ~held_out(5, 0))
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "rejected")


@query("op6_quality")
def op6(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels").select("doc_id", "quality")
    model = train_quality(docs, labels, ~held_out(4, 2))
    return classify(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")


@query("op11_source_divergence", sql=twins.OP11)
def op11(spark, d):
    return source_divergence(table(spark, d, "documents").select("text", "lang", "source"))


@query("op12_pieces")
def op12(spark, d):
    model = piece_model("piece_bpe_32k.model")
    encoded = encode(table(spark, d, "documents"), model)
    return decode(encoded, model).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


@query("op13_collocations", sql=twins.OP13)
def op13(spark, d):
    return collocations(table(spark, d, "documents").select("text", "lang"))
