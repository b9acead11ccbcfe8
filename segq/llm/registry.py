"""The thin opN_* queries and their SQL."""

from __future__ import annotations

from segq.llm import alignment, conversation_trie, decontaminate, exact_dedup, html_text, lattice_lm, line_dedup, mixing, ngram_join, suffix_dedup, token_files, toxicity, warc
from segq.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark, sf_dir):
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op4_lattice_lm(spark, sf_dir):
    return lattice_lm.lattice_lm(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), class_col="lang")


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup(table(spark, sf_dir, "pages"))


def op8_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "hits.*")


def op9_html_text(spark, sf_dir):
    return html_text.html_text(table(spark, sf_dir, "pages"))


def op10_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op11_warc(spark, sf_dir):
    return warc.facts(warc.archived(table(spark, sf_dir, "pages")))


def op12_align(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op13_conversation_trie(spark, sf_dir):
    convs = conversation_trie.paths_of(table(spark, sf_dir, "conversations"))
    return conversation_trie.trie_digest(conversation_trie.prefix_trie(conversation_trie.rebuilt(convs)))


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql():
    return {"op5_exact_dedup": exact_dedup.SQL, "op7_line_dedup": line_dedup.SQL, "op8_decontaminate": decontaminate.SQL}
