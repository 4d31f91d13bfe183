"""The queries of this subpackage and the SQL that some of them are checked against."""

from __future__ import annotations

import corpus_pipeline

from shelfmark.llm import chat, decontam, langid, licenses, linededup, packing, simhash, topk, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        chat.op1_chat_format, langid.op2_language_id, packing.op3_retrieval_packing, decontam.op4_decontaminate, warc.op5_warc,
        topk.op6_exact_topk, toxicity.op7_toxicity, simhash.op8_simhash, linededup.op9_line_dedup, licenses.op10_license_scan,
    )
} | {"pipeline": corpus_pipeline.run}

SQL = {"op1_chat_format": chat.OP1_SQL, "op4_decontaminate": decontam.OP4_SQL, "op6_exact_topk": topk.OP6_SQL, "op9_line_dedup": linededup.OP9_SQL}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
