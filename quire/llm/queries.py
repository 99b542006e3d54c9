"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.llm import chat, decontaminate, katz, language, lexical, line_dedup, mixing, near_dedup, quality, substring_dedup, token_files, trie, url_filter
from quire.llm.scratch import cut, new_path, text_mb
from quire.sources.tables import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op2_chat_format(spark, sf_dir):
    return chat.parse_chats(table(spark, sf_dir, "conversations"))


def op3_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.outcomes(table(spark, sf_dir, "labels"))
    r = url_filter.filter_urls(pages, judged)
    return r.select("page_id", "reputation.host", "reputation.path", "reputation.rule", "reputation.verdict")


def op4_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    got = quality.judge(docs, forest)
    return got.select("doc_id", *[f"quality.{c}" for c in (*quality.BASE, "base_failed", "kept", "probability")])


def op5_katz_score(spark, sf_dir):
    return katz.train_and_score(table(spark, sf_dir, "documents").select("doc_id", "text")).scores


def op6_near_dups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, size=3, percent=85)


def op7_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = new_path(spark, "token-files")
    token_files.write(docs, "doc_id", "text", tokenizer_path(), path, new_path(spark, "token-work"), text_mb(docs, "text"))
    got = token_files.read(spark, path)
    return got.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


def op8_substring_dedup(spark, sf_dir):
    got = substring_dedup.repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return got.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_line_dedup(spark, sf_dir):
    got = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "line_stats.n_lines", "line_stats.n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op10_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark, sf_dir):
    turns = trie.numbered(table(spark, sf_dir, "conversations"))
    return trie.nodes(*trie.with_heads(turns)).drop("a", "b")


def op12_lexical_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.search(docs, table(spark, sf_dir, "benchmark"))


def op13_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~language.held_out()))
    got = cut(language.identify(docs, model, keep=["doc_id"]), "languages")
    return got.select("doc_id", language.held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score", F.size("language.spans").alias("n_spans"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_chat_format, op3_url_filter, op4_quality, op5_katz_score, op6_near_dups, op7_token_files, op8_substring_dedup, op9_line_dedup, op10_decontaminate, op11_prefix_trie, op12_lexical_search, op13_language_id)}

ORACLE_SQL = {
    "op1_mix_sources": mixing.ORACLE,
    "op3_url_filter": url_filter.ORACLE,
    "op6_near_dups": near_dedup.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op10_decontaminate": decontaminate.ORACLE,
    "op11_prefix_trie": trie.ORACLE,
    "op12_lexical_search": lexical.ORACLE,
}
