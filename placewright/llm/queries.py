"""The registered queries of the operators and their SQL twins."""
from __future__ import annotations

import corpus_pipeline

from . import (chat_format, decontaminate, factor_machine, filter_audit, hyper_minhash, knn_join, line_dedup, line_rules, repeated_spans, sentence_pieces, string_kernel,
               turn_repair, url_filter)

QUERIES = {f.__name__: f for f in (
    url_filter.op1_url_filter, line_rules.op2_line_rules, decontaminate.op3_decontaminate, line_dedup.op4_line_dedup,
    factor_machine.op5_factor_machine, chat_format.op6_chat_format, repeated_spans.op7_repeated_spans, hyper_minhash.op8_hyper_minhash,
    string_kernel.op9_string_kernel, sentence_pieces.op10_sentence_pieces, turn_repair.op11_turn_repair, knn_join.op12_knn_join,
    filter_audit.op13_filter_audit)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE = {"op1_url_filter": url_filter.SQL, "op2_line_rules": line_rules.SQL, "op3_decontaminate": decontaminate.SQL,
          "op4_line_dedup": line_dedup.SQL, "op6_chat_format": chat_format.SQL, "op8_hyper_minhash": hyper_minhash.SQL,
          "op11_turn_repair": turn_repair.SQL, "op12_knn_join": knn_join.SQL, "op13_filter_audit": filter_audit.SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
