"""Explicit schemas of every table. Nothing is ever inferred: dictionaries with data-dependent
keys are maps, and an absent value (NULL) is kept apart from an empty one ([])."""

KW = "STRUCT<label: STRING, conceptId: BIGINT, instanceOfType: BIGINT>"
CITATION = "STRUCT<nro: BIGINT, id: STRING, name: STRING>"
RELATED_ACT = f"STRUCT<nro: BIGINT, title: STRING, validity: STRING, relationData: ARRAY<{CITATION}>>"
RAW_RELATED_ACT = (
    f"STRUCT<nro: BIGINT, title: STRING, lawType: STRING, validity: STRING, relationData: ARRAY<{CITATION}>>"
)
UNIT = "STRUCT<nro: BIGINT, id: STRING, name: STRING, stateName: STRING>"
RELATION = (
    "STRUCT<title: STRING, nro: BIGINT, lawType: STRING, validity: STRING, "
    f"relationData: STRUCT<units: ARRAY<{UNIT}>>>"
)
ELEMENT = f"STRUCT<children: ARRAY<STRING>, parent: STRING, text: STRING, keywords: ARRAY<{KW}>>"
RECONSTRUCT = "STRUCT<cite_id: STRING, text: STRING>"

QUESTION = f"nro BIGINT, title STRING, relatedActs ARRAY<{RELATED_ACT}>, keywords ARRAY<{KW}>"
RAW_QUESTION = (
    "nro BIGINT, title STRING, question STRING, answer STRING, justification STRING, "
    f"relatedActs ARRAY<{RAW_RELATED_ACT}>, keywords ARRAY<{KW}>"
)
TREE_ACT = (
    "nro BIGINT, id STRING, citeLink STRING, actLawType STRING, title STRING, shortQuote STRING, "
    f"elements MAP<STRING, {ELEMENT}>, keywords ARRAY<{KW}>"
)
KEYWORD = f"conceptId BIGINT, instanceOfType BIGINT, actRelations ARRAY<{RELATION}>"
LEAF_ACT = f"nro BIGINT, title STRING, actLawType STRING, citeLink STRING, reconstruct MAP<STRING, {RECONSTRUCT}>"
VECTOR_ACT = (
    "act_nro BIGINT, parent_id STRING, reconstruct_id STRING, text STRING, parent_tokens INT, "
    f"text_tokens INT, chunk_id INT, total_chunks INT, keywords ARRAY<{KW}>, node_ids ARRAY<STRING>"
)


def struct_of(columns: str) -> str:
    """``a BIGINT, b STRING`` as the inside of ``STRUCT<...>``; only top-level names get a colon."""
    out, depth, word_done, start = [], 0, False, True
    for ch in columns:
        if ch == "<":
            depth += 1
        elif ch == ">":
            depth -= 1
        if depth == 0 and ch == ",":
            start, word_done = True, False
        elif start and not ch.isspace():
            start = False
        elif depth == 0 and ch == " " and not start and not word_done:
            out.append(":")
            word_done = True
        out.append(ch)
    return f"STRUCT<{''.join(out)}>"
