"""The subpackage's queries, and SQL for those that SQL can express."""

from cairn.llm import decontam, extraction, language, mixing, ngram_join, quality, repeats, rules, sanitise, toxicity

QUERIES = {"op1_ngram_join": ngram_join.op1_ngram_join, "op2_rules": rules.op2_rules, "op3_mixing": mixing.op3_mixing, "op4_quality": quality.op4_quality, "op5_decontam": decontam.op5_decontam, "op6_toxicity": toxicity.op6_toxicity, "op7_extraction": extraction.op7_extraction, "op8_language": language.op8_language, "op9_repeats": repeats.op9_repeats, "op10_sanitise": sanitise.op10_sanitise}
SQL = {"op2_rules": rules.OP2_SQL, "op3_mixing": mixing.OP3_SQL, "op5_decontam": decontam.OP5_SQL}
