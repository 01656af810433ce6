"""Policy text derived from the star schema, in SQL that Spark and DuckDB share.

The test tables hold next to no policy language, so clauses are composed from
`orders` and rules from `part`.  Each text is one constant used by both sides.
Lists are written with bars between entries.
"""

import re

#: #n stands for the order's number modulo n.
_TEXTS = [
    "The provider shall retain order #50 within #90 days of receipt.",
    "Users must not share record #40 with a vendor.",
    "Access must not be granted to file #50.",
    "Records are kept unless the controller objects, see Article #30(2) and Section 4.#9.",
    "A deployer shall not be required to log request #60.",
    "Output #25 means the response of a model.",
    "(a) the report for case #70",
    "- retain the audit log of tenant #20",
    "This measure may not apply to region #5.",
    "This document is maintained by the office.",
    "Operators should verify that at least #12 users approve, no later than 3 weeks.",
    "The organization may only process data where the law allows.",
    "Staff may choose any tool and must report it.",
    "An example: note the guidance of Annex B.",
    "The controller MUST disclose breaches to the extent permitted by law.",
    "",
    "Plain remark number #15.",
    "1. the system includes a gate and the processors are prohibited from bypass.",
    "It is unlawful for any AI actor to redact output #33; not exceeding 1,000.5 requests.",
    "“Quoted” duty: the user must answer prompt #11.",
]


def _composed(text: str) -> str:
    """SQL for a text of _TEXTS."""
    return "'" + re.sub(r"#(\d+)", r"' || CAST(o_orderkey % \1 AS STRING) || '", text) + "'"


_CASES = " ".join(f"WHEN {n} THEN {_composed(text)}" for n, text in enumerate(_TEXTS))

CLAUSES = f"""SELECT o_orderkey AS seq,
  'doc' || CAST(o_custkey % 40 AS STRING) || '/sec-' || CAST(o_custkey % 3 AS STRING) || '/sent_' || CAST(o_orderkey AS STRING) AS span_id,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'doc' || CAST(o_custkey % 40 AS STRING) END AS doc_id,
  CASE o_custkey % 3 WHEN 0 THEN 'Part|Scope' WHEN 1 THEN 'Annex|Examples' ELSE 'Requirements' END AS section,
  CASE WHEN o_orderkey % 29 = 0 THEN 'table' ELSE 'sentence' END AS kind,
  CAST(o_orderkey % 6 AS INT) AS page,
  CASE CAST(o_orderkey % {len(_TEXTS)} AS INT) {_CASES} END AS text
FROM {{orders}}"""

RULES = """SELECT p_partkey AS seq, 'r' || CAST(p_partkey AS STRING) AS rule_id,
  CASE p_size % 4 WHEN 0 THEN 'HIPAA Rule' WHEN 1 THEN 'NIST Framework' WHEN 2 THEN 'EU AI Act art. 5' ELSE 'House Policy' END AS doc,
  CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'sec ' || CAST(p_size % 7 AS STRING) END AS citation,
  'doc/part-' || CAST(p_size % 7 AS STRING) || '/sent_' || CAST(p_partkey % 90 AS STRING) AS span_id,
  CASE p_partkey % 6 WHEN 0 THEN 'Organization|SRE' WHEN 1 THEN 'end_users' WHEN 2 THEN 'DPO|security review' WHEN 3 THEN 'Service  Provider|Vendors' WHEN 4 THEN '' ELSE 'astronaut|patients' END AS actor,
  CASE p_partkey % 5 WHEN 0 THEN 'phi|Logs' WHEN 1 THEN 'source code' WHEN 2 THEN 'API keys|passport scan' WHEN 3 THEN '' ELSE 'photos|text' END AS data_domain,
  CASE p_partkey % 4 WHEN 0 THEN 'pre-production|on prem' WHEN 1 THEN 'Testing' WHEN 2 THEN 'internal' ELSE '' END AS context,
  CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'Data Breach, fines' WHEN 2 THEN 'unsafe output' ELSE 'harm ' || CAST(p_size % 9 AS STRING) END AS hazard,
  CASE p_partkey % 6 WHEN 0 THEN 'prod only' WHEN 1 THEN '' ELSE 'when asked' END AS conditions,
  CASE p_partkey % 5 WHEN 0 THEN 'Consent given|emergency' WHEN 1 THEN 'emergency|Consent, given' WHEN 2 THEN '' ELSE 'the user must not log ' || CAST(p_size % 3 AS STRING) END AS exceptions,
  CASE p_partkey % 8 WHEN 0 THEN 'The user must not log ' || CAST(p_size % 3 AS STRING) WHEN 1 THEN 'The model must redact output|The log must be kept'
    WHEN 2 THEN 'Provider shall report ' || CAST(p_size % 4 AS STRING) WHEN 3 THEN 'The user must log ' || CAST(p_size % 3 AS STRING)
    WHEN 4 THEN 'Fairness matters' WHEN 5 THEN 'Ensure that the prompt is answered' WHEN 6 THEN 'Teams should scan the repo' ELSE 'Deployers must-not ship' END AS requirements,
  CASE p_partkey % 4 WHEN 0 THEN 'https://www.nih.gov/x|plan.pdf' WHEN 1 THEN '' WHEN 2 THEN 'http://evil.example/a' ELSE ' report ' END AS evidence,
  CASE p_partkey % 5 WHEN 0 THEN 'High' WHEN 1 THEN 'medium' WHEN 2 THEN 'critical' WHEN 3 THEN '' ELSE 'low' END AS severity,
  CASE p_partkey % 6 WHEN 0 THEN 'io_check' WHEN 1 THEN 'IO_Check |log_check' WHEN 2 THEN '' WHEN 3 THEN 'ci_gate' WHEN 4 THEN ' io_check' ELSE 'repo_check|io_check' END AS signals,
  p_partkey % 3 <> 0 AS is_testable
FROM {part}"""

#: What a model might write, one kind for each of the first rows.
RAW = """SELECT p_partkey AS seq, CASE p_partkey % 8
  WHEN 0 THEN '{"rules":[{"rule_id":"a' || CAST(p_partkey AS STRING) || '","hazard":"h","severity":"low"}]}'
  WHEN 1 THEN 'Here: [{"rule_id":"b","hazard":" x "},{"rule_id":"c"}]'
  WHEN 2 THEN 'first [{"rule_id":"d"}] then more'
  WHEN 3 THEN 'no rules at all'
  WHEN 4 THEN '{"rule_id":"e' || CAST(p_partkey AS STRING) || '","hazard":" Leak ","severity":"HIGH","requirements":"one","scope":{"actor":"org"},"colour":"red","conditions":["a"," a ","b",""]}'
  WHEN 5 THEN '{"rule_id":null,"source":{"doc":"D","citation":"C","span_id":"S"},"scope":{"actor":["user","user"],"data_domain":[],"context":["prod"]},"hazard":"","conditions":[],"exceptions":[],"requirements":["r1","r2"],"evidence":[],"severity":"medium"}'
  WHEN 6 THEN '```{"benign":["a","b"],"adversarial":["c"," d "]}```'
  ELSE 'text {"benign":["a ","b"],"adversarial":["c","d"],"n":' || CAST(p_partkey AS STRING) || '} tail' END AS raw
FROM {part}"""

#: Boxes on pages: geometry from line items.
BLOCKS = """SELECT (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey * 100 + l_suppkey % 100 AS seq, 'doc' || CAST(l_orderkey % 25 AS STRING) AS doc_id, CAST(l_orderkey % 40 AS INT) AS page,
  CAST(l_partkey % 600 AS DOUBLE) AS x0, CAST(l_suppkey * 37 % 800 AS DOUBLE) AS y0, CAST(l_suppkey * 37 % 800 + 12 AS DOUBLE) AS y1, CAST(800 AS DOUBLE) AS height,
  CAST(6 + l_quantity % 9 AS DOUBLE) AS size,
  CASE l_partkey % 6 WHEN 0 THEN ' ' WHEN 1 THEN 'Figure ' || CAST(l_suppkey % 9 AS STRING) || '. A plot' WHEN 2 THEN 'table A' || CAST(l_suppkey % 5 AS STRING) || ' values'
    WHEN 3 THEN 'Fig. 2 shows' WHEN 4 THEN 'Section heading ' || CAST(l_suppkey AS STRING) ELSE 'see Table 3' END AS text
FROM {lineitem}"""

#: Gold spans and predictions from labelled documents.
SCORES = """SELECT 'span_' || CAST(doc_id AS STRING) AS span_id, CAST((doc_id * 7919) % 101 AS DOUBLE) / 101 AS score, quality = 1 AS hit, toxic = 1 AS other,
  'g' || CAST(doc_id % 4 AS STRING) || '|h' || CAST(doc_id % 3 AS STRING) AS gold_tokens,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'g' || CAST(doc_id % 3 AS STRING) || '|h' || CAST(doc_id % 3 AS STRING) END AS pred_tokens,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST((doc_id * 31) % 97 AS DOUBLE) / 97 END AS macro_f1,
  CAST((doc_id * 13) % 2 AS INT) AS test_correct, CAST((doc_id * 17) % 89 AS DOUBLE) / 89 AS signals_f1
FROM {labels}"""
