"""The queries of this subpackage and the SQL to check them against, by name."""

from riskloom.llm import (
    alignment, byte_bpe, decontamination, divergence, embedding_graph, licenses, secrets, simhash, token_counts, token_files, toxicity,
    warc, word_bpe,
)

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_embedding_graph": embedding_graph.op2_embedding_graph,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_simhash": simhash.op4_simhash,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_token_files": token_files.op6_token_files,
    "op7_warc": warc.op7_warc,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_word_bpe": word_bpe.op12_word_bpe,
    "op13_token_alignment": alignment.op13_token_alignment,
}
ORACLE: dict[str, str] = {
    "op2_embedding_graph": embedding_graph.OP2_SQL,
    "op7_warc": warc.OP7_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
}
