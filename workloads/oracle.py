"""DuckDB equivalents of the registered queries."""

from __future__ import annotations

from pactlens import config, taxonomy
from pactlens.functions import risk, validation
from workloads import derive
from workloads.registry import PROSE_LEXICON

BASE = config.Lexicon()
# The characters Python's str.strip() treats as whitespace.
WS = (r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def num(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


# --- text ---------------------------------------------------------------------------------------


def strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{WS}+|{WS}+$', '', 'g')"


def clean(x: str) -> str:
    return f"regexp_replace({strip(x)}, '{WS}+', ' ', 'g')"


def clean_clause(x: str) -> str:
    return clean(f"replace(coalesce({x}, ''), '<omitted>', ' ')")


def pieces(x: str) -> str:
    """Sentence list: every break becomes one marker character to split on."""
    return f"string_split(regexp_replace({x}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))"


def segments(name: str, source: str, keys: str, text: str) -> str:
    """CTE `name` (keys, sent_idx, sentence) from a table with a text column."""
    return f"""{name}_parts AS (SELECT {keys}, {pieces(text)} AS parts FROM {source}),
{name}_rows AS (SELECT {keys}, generate_subscripts(parts, 1) - 1 AS sent_idx,
  {strip('unnest(parts)')} AS sentence FROM {name}_parts),
{name} AS (SELECT {keys}, sent_idx::INTEGER AS sent_idx, sentence FROM {name}_rows WHERE sentence <> '')"""


def predicate_sql(h: str) -> str:
    return f"({array(derive.PREDICATES)})[{h} % 13 + 1]"


def tail_sql(h: str) -> str:
    return f"({array(derive.TAILS)})[({h} // 13) % 17 + 1]"


def fragment_sql(h: str) -> str:
    return (f"concat_ws(' ', ({array(derive.SUBJECTS)})[{h} % 5 + 1], "
            f"({array(derive.MODALS)})[{h} % 11 + 1], {predicate_sql(h)}, {tail_sql(h)})")


SEGS = segments("segs", "documents", "doc_id", "text")
CLAUSES = f"""{SEGS},
keyed AS (SELECT doc_id, sent_idx, doc_id * 31 + sent_idx * 17 AS h, sentence AS original FROM segs),
frags AS (SELECT *, {fragment_sql('h')} AS frag FROM keyed),
cl AS (SELECT doc_id, sent_idx, h, frag, concat_ws(' ', original, frag) AS sentence,
  lower(concat_ws(' ', original, frag)) AS l FROM frags)"""
DOC_TEXT = f"""{CLAUSES},
joined AS (SELECT doc_id, string_agg(sentence, '. ' ORDER BY sent_idx) AS text FROM cl GROUP BY doc_id),
{segments('dsegs', 'joined', 'doc_id', 'text')},
dcl AS (SELECT doc_id, sent_idx, sentence, lower(sentence) AS l FROM dsegs)"""


# --- keyword tier and severity ---------------------------------------------------------------------


def any_of(l: str, words) -> str:
    return "(" + " OR ".join(f"contains({l}, {lit(w)})" for w in words) + ")"


def keyword(l: str, lex=BASE) -> str:
    whens = " ".join(f"WHEN {any_of(l, words)} THEN {lit(c)}" for c, words in lex.categories)
    return f"(CASE {whens} END)"


def modal(l: str, lex=BASE) -> str:
    word = r"[^\p{L}\p{N}_]"
    terms = [f"CASE WHEN regexp_matches({l}, '(^|{word}){m}({word}|$)') THEN {num(w)} ELSE {num(0)} END"
             for m, w in lex.modals]
    return f"greatest({num(0)}, {', '.join(terms)})"


def delta(l: str, lex=BASE) -> str:
    total = num(0)
    for phrase in lex.amplifiers:
        total = f"({total} + CASE WHEN contains({l}, {lit(phrase)}) THEN {num(lex.amplifier_step)} ELSE {num(0)} END)"
    for phrase in lex.suppressors:
        total = f"({total} - CASE WHEN contains({l}, {lit(phrase)}) THEN {num(lex.suppressor_step)} ELSE {num(0)} END)"
    return f"greatest({num(lex.delta_floor)}, least({num(lex.delta_ceiling)}, {total}))"


def base(t: str, lex=BASE) -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {num(w)}" for k, w in lex.base_weights)
    return f"(CASE {t} {whens} ELSE {num(lex.default_base_weight)} END)"


def composite(m: str, d: str, b: str, c: str) -> str:
    up = f"{num(0.2)} * greatest({num(0)}, {d} + {num(0.5)})"
    withc = f"((({num(0.3)} * {m} + {up}) + {num(0.3)} * {b}) + {num(0.2)} * {c})"
    without = f"(({num(0.4)} * {m} + {up}) + {num(0.4)} * {b})"
    raw = f"(CASE WHEN {c} IS NULL THEN {without} ELSE {withc} END)"
    return f"greatest({num(0)}, least({num(1)}, {raw} + {d} * {num(0.15)}))"


def severity(x: str) -> str:
    return f"(CASE WHEN {x} >= {num(0.65)} THEN 'High' WHEN {x} >= {num(0.35)} THEN 'Medium' ELSE 'Low' END)"


def scored(name: str, source: str, keep: str, conf: str = "confidence", lex=BASE) -> str:
    """CTE `name` adding severity and severity_score to rows with l, risk_type and a confidence."""
    return f"""{name}_sig AS (SELECT {keep}, {modal('l', lex)} AS m, {delta('l', lex)} AS d,
  {base('risk_type', lex)} AS b FROM {source}),
{name}_x AS (SELECT *, {composite('m', 'd', 'b', conf)} AS x FROM {name}_sig),
{name} AS (SELECT *, {severity('x')} AS severity, round_even(x, 4) AS severity_score FROM {name}_x)"""


KW = f"""{CLAUSES},
kw AS (SELECT *, {keyword('l')} AS risk_type, NULL::DOUBLE AS confidence FROM cl),
kw_hit AS (SELECT * FROM kw WHERE risk_type IS NOT NULL)"""
KW_SCORED = f"{KW},\n{scored('ks', 'kw_hit', '*')}"


def explanation(t: str, s: str) -> str:
    whens = " ".join(
        f"WHEN {lit(k)} THEN {lit(a)} || {s} || {lit(b)} || CASE WHEN {s} = 'High' THEN {lit(hi)} ELSE {lit(lo)} END"
        for k, (a, b, hi, lo) in risk.EXPLANATIONS.items())
    return f"(CASE {t} {whens} ELSE {lit(risk.DEFAULT_EXPLANATION)} END)"


# --- tiers ---------------------------------------------------------------------------------------------

LABELS = array(derive.LABELS)
TIERS = f"""{CLAUSES},
s1 AS (SELECT doc_id, sent_idx, CASE WHEN h % 23 = 0 THEN 'None' ELSE ({LABELS})[h % 6 + 1] END AS label,
  ((h * 37) % 997) / {num(997)} AS p FROM cl WHERE h % 19 <> 0),
s2 AS (SELECT doc_id, sent_idx, ({LABELS})[(h // 6) % 6 + 1] AS label,
  CASE WHEN h % 31 = 0 THEN {num(0)} ELSE ((h * 53) % 991) / {num(991)} END AS p FROM cl WHERE h % 29 <> 0)"""


def calibrated(p: str, t: float = 1.5) -> str:
    return (f"(CASE WHEN {p} > 0 AND {p} < 1 THEN round_even(1 / (1 + exp(-(ln({p} / (1 - {p})) / {num(t)}))), 4) "
            f"ELSE {p} END)")


def decisions(enforce: bool) -> str:
    """CTEs d1, d2 with (doc_id, sent_idx, label, confidence) of each tier."""
    gate1 = f" AND {calibrated('p')} >= {num(0.6)}" if enforce else ""
    gate2 = f" AND NOT (p <> 0 AND p < {num(0.5)})" if enforce else ""
    return f"""d1 AS (SELECT cl.doc_id, cl.sent_idx, CASE WHEN label <> 'None'{gate1} THEN label END AS label,
  CASE WHEN label IS NULL THEN {num(0)} WHEN label = 'None' THEN p ELSE {calibrated('p')} END AS confidence
  FROM cl LEFT JOIN s1 USING (doc_id, sent_idx)),
d2 AS (SELECT cl.doc_id, cl.sent_idx, CASE WHEN label <> 'None'{gate2} THEN label END AS label,
  coalesce(p, {num(0)}) AS confidence FROM cl LEFT JOIN s2 USING (doc_id, sent_idx))"""


def cascade(mode: str) -> str:
    t1 = mode in ("auto", "transformer")
    t2 = mode in ("auto", "ml")
    first = "d1.label" if t1 else "NULL"
    second = "d2.label" if t2 else "NULL"
    carried = "d2.confidence" if t2 else "NULL"
    conf = f"CASE WHEN {first} IS NOT NULL THEN d1.confidence ELSE {carried} END" if t1 else carried
    return f"""{TIERS},
{decisions(mode == 'auto')},
dec AS (SELECT cl.*, coalesce({first}, {second}, {keyword('cl.l')}) AS risk_type, ({conf})::DOUBLE AS confidence,
  CASE WHEN {first} IS NOT NULL THEN 'transformer' WHEN {second} IS NOT NULL THEN 'ml' ELSE 'keyword' END AS detector
  FROM cl JOIN d1 USING (doc_id, sent_idx) JOIN d2 USING (doc_id, sent_idx)),
hit AS (SELECT * FROM dec WHERE risk_type IS NOT NULL),
{scored('sc', 'hit', '*')}"""


CASCADE_OUT = "SELECT doc_id, sent_idx, risk_type, severity, severity_score, confidence, detector FROM sc"


def scorer_plugin(failed: str = "false") -> str:
    # The first of equal scores wins, so a top score of 0.0 gives the first label; where the scorer fails there is none.
    top = f"CASE WHEN NOT {failed} THEN ({LABELS})[CASE WHEN length(sentence) % 97 = 0 THEN 1 ELSE length(sentence) % 6 + 1 END] END"
    return f"""WITH {CLAUSES},
p AS (SELECT *, {top} AS label, (length(sentence) % 97) / {num(97)} AS p FROM cl),
q AS (SELECT *, CASE WHEN label <> 'None' AND {calibrated('p')} >= {num(0.6)} THEN label END AS first,
  CASE WHEN label <> 'None' AND NOT (p <> 0 AND p < {num(0.5)}) THEN label END AS second FROM p),
dec AS (SELECT doc_id, sent_idx, l, coalesce(first, second, {keyword('l')}) AS risk_type,
  CASE WHEN first IS NOT NULL THEN {calibrated('p')} ELSE p END AS confidence,
  CASE WHEN first IS NOT NULL THEN 'transformer' WHEN second IS NOT NULL THEN 'ml' ELSE 'keyword' END AS detector
  FROM q),
hit AS (SELECT * FROM dec WHERE risk_type IS NOT NULL),
{scored('sc', 'hit', '*')}
{CASCADE_OUT}"""


# --- reports ----------------------------------------------------------------------------------------------

COUNTS = """count_if(severity = 'High')::BIGINT AS high, count_if(severity = 'Medium')::BIGINT AS medium,
  count_if(severity = 'Low')::BIGINT AS low"""
DETECTOR_COUNTS = """count_if(detector = 'transformer')::BIGINT AS n_transformer,
  count_if(detector = 'ml')::BIGINT AS n_ml, count_if(detector = 'keyword')::BIGINT AS n_keyword"""
PERCENT = "CASE WHEN total_sentences > 0 THEN round_even(risky_count / total_sentences * 100, 2) ELSE 0 END::DOUBLE"

DOC_KW = f"""{DOC_TEXT},
dkw AS (SELECT *, {keyword('l')} AS risk_type, NULL::DOUBLE AS confidence, 'keyword' AS detector FROM dcl),
dhit AS (SELECT * FROM dkw WHERE risk_type IS NOT NULL),
{scored('ds', 'dhit', '*')},
dsum AS (SELECT doc_id, count(*)::BIGINT AS risky_count, {COUNTS}, {DETECTOR_COUNTS},
  md5(string_agg(concat_ws('|', risk_type, severity, detector, {explanation('risk_type', 'severity')}, sentence),
    chr(10) ORDER BY sent_idx)) AS risks_md5 FROM ds GROUP BY doc_id),
dtot AS (SELECT doc_id, count(*)::BIGINT AS total_sentences FROM dcl GROUP BY doc_id),
dall AS (SELECT documents.doc_id, coalesce(total_sentences, 0) AS total_sentences,
  coalesce(risky_count, 0) AS risky_count, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium,
  coalesce(low, 0) AS low, coalesce(n_transformer, 0) AS n_transformer, coalesce(n_ml, 0) AS n_ml,
  coalesce(n_keyword, 0) AS n_keyword, coalesce(risks_md5, md5('')) AS risks_md5
  FROM documents LEFT JOIN dtot USING (doc_id) LEFT JOIN dsum USING (doc_id))"""

REPORT = f"""WITH {DOC_KW}
SELECT doc_id, total_sentences, risky_count, {PERCENT} AS risk_percentage, high, medium, low,
  'keyword' AS mode, n_keyword, risks_md5 FROM dall"""


# --- corpora -----------------------------------------------------------------------------------------------


def _merged() -> str:
    parts = []
    for rank, name in enumerate(derive.SOURCES):
        distance = f"(({rank} + 3 - doc_id % 3) % 3)"
        parts.append(f"""SELECT sentence,
  CASE WHEN ({distance} = 0 AND h % 7 = 0) OR ({distance} = 2 AND h % 4 = 0) THEN 'None' ELSE label END AS label,
  seq, '{name}' AS source, {rank}::BIGINT AS source_rank FROM lab
  WHERE {distance} = 0 OR ({distance} = 1 AND h % 5 = 0) OR ({distance} = 2 AND h % 10 = 0)""")
    return f"""{CLAUSES},
lab AS (SELECT doc_id, h, sentence, doc_id * 1000000 + sent_idx AS seq, coalesce({keyword('l')}, 'None') AS label
  FROM cl),
merged AS ({' UNION ALL '.join(parts)})"""


MERGED = _merged()
ROW_HASH = "md5(concat_ws('|', '42', source_rank, seq))"


def first_seen(*rest: str) -> str:
    cols = "".join(f", {c}" for c in rest)
    return f"""SELECT sentence{cols} FROM merged
QUALIFY row_number() OVER (PARTITION BY sentence ORDER BY source_rank, seq) = 1"""


def capped(cap: str, cols: str, extra: str = "") -> str:
    return f"""WITH {MERGED},
sizes AS (SELECT label, count(*) AS n FROM merged GROUP BY label),
ranked AS (SELECT merged.*, sizes.n AS n_label, row_number() OVER (PARTITION BY label ORDER BY {ROW_HASH}) AS rn
  FROM merged JOIN sizes USING (label)){extra}
SELECT {cols} FROM ranked WHERE rn <= {cap}"""


def mapping(name: str, pairs: dict, key: str, value: str) -> str:
    rows = ", ".join(f"({lit(k)}, {lit(v)})" for k, v in pairs.items())
    return f"{name} AS (SELECT * FROM (VALUES {rows}) AS t({key}, {value}))"


def question_category(q: str) -> str:
    whens = " ".join(f"WHEN {any_of(f'lower({q})', words)} THEN {lit(c)}" for c, words in taxonomy.QUESTION_RULES)
    return f"(CASE {whens} END)"


WIDE_NAMES = (*taxonomy.POSITIVE_COLUMNS, *taxonomy.NONE_COLUMNS)
WIDE_CLASSES = {**{c: "None" for c in taxonomy.NONE_COLUMNS}, **taxonomy.POSITIVE_COLUMNS}
WIDE = f"""{CLAUSES},
{mapping('wmap', WIDE_CLASSES, 'clause', 'label')},
cells AS (SELECT doc_id, ({array(WIDE_NAMES)})[sent_idx % 15 + 1] AS clause,
  string_agg(sentence, '. <omitted>' || chr(10) ORDER BY sent_idx) AS raw FROM cl GROUP BY doc_id, sent_idx % 15),
wide AS (SELECT doc_id, clause, label, {clean_clause('raw')} AS text FROM cells JOIN wmap USING (clause)
  WHERE {clean_clause('raw')} <> ''),
{segments('wsegs', 'wide', 'doc_id, clause, label', 'text')},
wclean AS (SELECT label, {clean('sentence')} AS sentence FROM wsegs),
wpos AS (SELECT DISTINCT sentence, label FROM wclean WHERE label <> 'None' AND sentence <> ''),
wneg AS (SELECT DISTINCT sentence FROM wclean
  WHERE label = 'None' AND sentence <> '' AND {keyword('lower(sentence)')} IS NULL)"""

QA = f"""{CLAUSES},
para AS (SELECT doc_id, string_agg(sentence, '. ' ORDER BY sent_idx) AS context FROM cl GROUP BY doc_id),
qa AS (SELECT doc_id, concat_ws(' ', {predicate_sql('h')}, {tail_sql('h')}) AS question,
  {strip("CASE WHEN h % 12 = 0 THEN ' N/A ' WHEN h % 8 = 0 THEN sentence ELSE frag END")} AS answer
  FROM cl WHERE h % 4 = 0),
ans AS (SELECT doc_id, question, {question_category('question')} AS label, answer FROM qa
  WHERE {question_category('question')} IS NOT NULL AND answer <> '' AND lower(answer) NOT IN ('n/a', 'na')),
withqa AS (SELECT * FROM para WHERE doc_id IN (SELECT doc_id FROM qa)),
{segments('csegs', 'withqa', 'doc_id', 'context')},
{segments('asegs', 'ans', 'doc_id, label', 'answer')},
snips AS (SELECT DISTINCT doc_id, answer FROM ans),
qpos AS (SELECT DISTINCT sentence, label FROM asegs),
qneg AS (SELECT DISTINCT sentence FROM csegs WHERE NOT EXISTS (
  SELECT 1 FROM snips WHERE snips.doc_id = csegs.doc_id AND contains(csegs.sentence, snips.answer)))"""


def prepared(ctes: str, pos: str, neg: str, ratio: float) -> str:
    return f"""WITH {ctes},
picked AS (SELECT sentence, row_number() OVER (ORDER BY md5('42|' || sentence)) AS rn FROM {neg})
SELECT sentence, label FROM {pos} UNION ALL
SELECT sentence, 'None' AS label FROM picked
WHERE rn <= (SELECT floor(count(*) * {num(ratio)})::BIGINT FROM {pos})"""


PAIRS = f"""{TIERS},
pairs AS (SELECT coalesce({keyword('l')}, 'None') AS y_true, s2.label AS y_pred, s2.p AS confidence,
  coalesce({keyword('l')}, 'None') = s2.label AS correct FROM cl JOIN s2 USING (doc_id, sent_idx)),
bins AS (SELECT least(trunc(confidence * 10)::BIGINT, 9) AS bin, count(*)::BIGINT AS n,
  sum(confidence) AS conf, count_if(correct) AS ok FROM pairs GROUP BY 1),
sides AS (SELECT label, sum(sup) AS support, sum(pred) AS predicted, sum(tp) AS tp FROM (
  SELECT y_true AS label, 1 AS sup, 0 AS pred, (y_true = y_pred)::INT AS tp FROM pairs
  UNION ALL SELECT y_pred, 0, 1, 0 FROM pairs) GROUP BY label),
rated AS (SELECT label, support::BIGINT AS support, tp, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall FROM sides),
report AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
  ELSE 0 END AS f1 FROM rated)"""

# --- features -------------------------------------------------------------------------------------------------

TOKENS = r"regexp_extract_all(lower(sentence), '[\p{L}\p{N}_]{2,}')"
BIGRAMS = "list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])"
TERMS = f"list_concat(t, CASE WHEN len(t) > 1 THEN {BIGRAMS} ELSE [] END)"
TFIDF = f"""{CLAUSES},
tok AS (SELECT doc_id, sent_idx, {TOKENS} AS t FROM cl),
tf AS (SELECT doc_id, sent_idx, term, count(*) AS tf FROM (
  SELECT doc_id, sent_idx, unnest({TERMS}) AS term FROM tok) GROUP BY ALL),
top AS (SELECT term, sum(tf)::BIGINT AS cf, count(*)::BIGINT AS df FROM tf GROUP BY term
  ORDER BY cf DESC, term LIMIT 20000),
vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_idx, cf, df,
  ln((1 + (SELECT count(*) FROM cl)) / (1 + df)) + 1 AS idf FROM top),
w AS (SELECT doc_id, sent_idx, term, (1 + ln(tf)) * idf AS w FROM tf JOIN vocab USING (term)),
norms AS (SELECT doc_id, sent_idx, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
weights AS (SELECT doc_id, sent_idx, term, w / norm AS weight FROM w JOIN norms USING (doc_id, sent_idx))"""


def oracle_sql() -> dict:
    out = {}
    key = "doc_id, sent_idx"

    out["segment_sentences"] = f"WITH {SEGS} SELECT doc_id, sent_idx, sentence FROM segs"
    messy = "chr(32) || chr(9) || replace(text, '. ', '.  <omitted>' || chr(10)) || chr(12288)"
    out["clean_text"] = f"""WITH m AS (SELECT doc_id, {messy} AS text FROM documents)
SELECT doc_id, {clean('text')} AS cleaned, {clean_clause('text')} AS clause FROM m WHERE {clean('text')} <> ''"""
    out["tokens"] = f"""WITH {SEGS}, x AS (SELECT {key}, {TOKENS} AS t FROM segs)
SELECT {key}, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens FROM x"""
    out["ngrams"] = f"""WITH {SEGS}, x AS (SELECT {key}, {TOKENS} AS t FROM segs),
y AS (SELECT {key}, {TERMS} AS g FROM x)
SELECT {key}, len(g)::BIGINT AS n_terms, array_to_string(g, '|') AS terms FROM y"""

    hits = ", ".join(f"CASE WHEN {any_of('l', words)} THEN {lit(c)} END" for c, words in BASE.categories)
    out["detect_risk_types"] = f"WITH {CLAUSES} SELECT {key}, concat_ws(',', {hits}) AS risk_types FROM cl"
    out["keyword_risk"] = f"WITH {KW} SELECT {key}, risk_type FROM kw_hit"
    out["modal_score"] = f"WITH {CLAUSES} SELECT {key}, {modal('l')} AS modal FROM cl"
    out["amplifier_score"] = f"WITH {CLAUSES} SELECT {key}, {delta('l')} AS delta FROM cl"
    both = f"""WITH {KW_SCORED},
given AS (SELECT doc_id, sent_idx, l, risk_type, severity AS s0, severity_score AS x0,
  ((h * 53) % 991) / {num(991)} AS conf FROM ks),
{scored('gs', 'given', '*', 'conf')}"""
    out["severity_score"] = (f"{both} SELECT {key}, risk_type, x0 AS score, "
                             f"severity_score AS score_with_confidence FROM gs")
    out["severity_label"] = f"{both} SELECT {key}, risk_type, s0 AS label, severity AS label_with_confidence FROM gs"

    expl = explanation("risk_type", "severity")
    out["explanations"] = f"WITH {KW_SCORED} SELECT {key}, {expl} AS explanation FROM ks"
    task = risk.PROMPT_TASK
    out["explain_prompts"] = f"""WITH {KW_SCORED} SELECT {key}, sentence, risk_type, severity,
{lit(risk.PROMPT_SYSTEM)} AS system,
{lit(task)} || chr(10) || chr(10) || 'Risk type: ' || risk_type || chr(10) || 'Severity: ' || severity
  || chr(10) || 'Sentence: ' || sentence AS "user" FROM ks"""
    out["explain_with_fallback"] = f"""WITH {KW_SCORED} SELECT {key}, risk_type, severity,
CASE WHEN h % 9 = 0 THEN {lit(risk.EMPTY_ANSWER)} WHEN h % 3 = 0 THEN {strip("'In short: ' || sentence")}
  ELSE {expl} END AS explanation,
CASE WHEN h % 3 = 0 THEN 'llm' ELSE 'template' END AS source FROM ks"""
    out["validate_requests"] = f"""WITH {CLAUSES},
r AS (SELECT {key}, {strip("CASE WHEN h % 11 = 0 THEN '  ' WHEN h % 101 = 0 THEN repeat(sentence, 120) ELSE sentence END")} AS s,
  CASE WHEN h % 13 <> 0 THEN ({LABELS})[h % 6 + 1] ELSE '' END AS risk_type,
  CASE WHEN h % 17 = 0 THEN '' ELSE 'High' END AS severity FROM cl)
SELECT {key}, length(s)::BIGINT AS n_chars, risk_type, severity,
CASE WHEN s = '' OR risk_type = '' OR severity = '' THEN {lit(validation.ERR_MISSING_FIELDS)}
  WHEN length(s) > 8000 THEN {lit(validation.ERR_TOO_LONG)} END AS error FROM r"""
    out["validate_inputs"] = f"""SELECT doc_id,
CASE WHEN doc_id % 6 IN (1, 2) THEN 'file' WHEN doc_id % 6 IN (3, 4) THEN NULL
  WHEN doc_id % 7 > 1 AND {strip('text')} <> '' THEN 'text' END AS input_kind,
CASE WHEN doc_id % 6 IN (3, 4) THEN {lit(validation.ERR_FILE_TYPE)} WHEN doc_id % 6 IN (1, 2) THEN NULL
  WHEN doc_id % 7 > 1 AND {strip('text')} <> '' THEN NULL ELSE {lit(validation.ERR_NO_INPUT)} END AS error
FROM documents"""

    out["rejected_inputs"] = out["validate_inputs"]
    known = ", ".join(f"({lit(e)})" for e in (validation.ERR_FILE_TYPE, validation.ERR_NO_INPUT, validation.ERR_TOO_LARGE, "other"))
    out["input_errors"] = f"""WITH v AS ({out['validate_inputs']}), k(error) AS (VALUES (NULL), {known})
SELECT k.error, count(v.doc_id)::BIGINT AS n FROM k LEFT JOIN v ON v.error IS NOT DISTINCT FROM k.error GROUP BY 1"""
    out["calibrate_confidence"] = f"""WITH {CLAUSES}, x AS (SELECT {key}, ((h * 37) % 997) / {num(997)} AS p FROM cl)
SELECT {key}, p, {calibrated('p')} AS calibrated, {calibrated('p', 2.5)} AS calibrated_hot FROM x"""
    out["temperature_softmax"] = f"""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE / {num(1.5)} AS v,
  generate_subscripts(embedding, 1)::BIGINT - 1 AS pos FROM embeddings)
SELECT vec_id, pos, round_even(exp(v - max(v) OVER w) / sum(exp(v)) OVER w * exp(max(v) OVER w), 9) AS p
FROM x WINDOW w AS (PARTITION BY vec_id)"""
    out["top1_label"] = f"WITH {TIERS} SELECT {key}, label, p AS confidence FROM s1"
    out["tier1_decision"] = f"WITH {TIERS}, {decisions(True)} SELECT {key}, label, confidence FROM d1"
    out["tier2_decision"] = f"WITH {TIERS}, {decisions(True)} SELECT {key}, label, confidence FROM d2"
    for mode in ("auto", "transformer", "ml", "keyword"):
        out[f"cascade_{mode}"] = f"WITH {cascade(mode)} {CASCADE_OUT}"
    out["analyze_risks"] = f"""WITH {cascade('auto')} SELECT {key}, sentence AS original_sentence, risk_type, severity,
severity_score, {expl} AS explanation, 'template' AS explanation_source,
round_even(confidence, 4) AS confidence, detector FROM sc"""
    out["scorer_plugin"] = scorer_plugin()
    out["scorer_failures"] = scorer_plugin("(length(sentence) % 97 = 0)")
    lex = PROSE_LEXICON
    out["custom_lexicon"] = f"""WITH {SEGS}, lx AS (SELECT {key}, lower(sentence) AS l FROM segs),
t AS (SELECT *, {keyword('l', lex)} AS risk_type, NULL::DOUBLE AS confidence FROM lx),
hit AS (SELECT * FROM t WHERE risk_type IS NOT NULL),
{scored('sc', 'hit', '*', lex=lex)}
SELECT {key}, risk_type, severity, severity_score FROM sc"""

    out["severity_distribution"] = f"""WITH {KW_SCORED}, c AS (SELECT doc_id, {COUNTS} FROM ks GROUP BY doc_id)
SELECT documents.doc_id, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low
FROM documents LEFT JOIN c USING (doc_id)"""
    out["detector_distribution"] = f"""WITH {cascade('auto')}, c AS (SELECT doc_id, {DETECTOR_COUNTS} FROM sc GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_transformer, 0) AS n_transformer, coalesce(n_ml, 0) AS n_ml,
coalesce(n_keyword, 0) AS n_keyword FROM documents LEFT JOIN c USING (doc_id)"""
    out["cascade_report_roundtrip"] = f"""WITH recs AS ({out['analyze_risks']}),
tot AS ({out['segment_sentences'].replace('SELECT', 'SELECT', 1)}),
t AS (SELECT doc_id, count(*)::BIGINT AS total_sentences FROM tot GROUP BY doc_id),
s AS (SELECT doc_id, count(*)::BIGINT AS risky_count, {COUNTS}, md5(string_agg(concat_ws(
  '|', risk_type, severity, detector, explanation, original_sentence), chr(10) ORDER BY sent_idx)) AS risks_md5 FROM recs GROUP BY doc_id),
a AS (SELECT documents.doc_id, coalesce(total_sentences, 0) AS total_sentences, coalesce(risky_count, 0) AS risky_count,
  coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(risks_md5, md5('')) AS risks_md5
  FROM documents LEFT JOIN t USING (doc_id) LEFT JOIN s USING (doc_id))
SELECT doc_id, total_sentences, risky_count, {PERCENT} AS risk_percentage, high, medium, low, 'auto' AS mode, risks_md5 FROM a"""
    out["stream_score_auto"] = out["cascade_report_roundtrip"]
    rank = " ".join(f"WHEN {lit(c)} THEN {i}" for i, c in enumerate(BASE.category_names))
    out["category_shares"] = f"""WITH {KW_SCORED},
c AS (SELECT risk_type, (CASE risk_type {rank} END)::BIGINT AS cat_rank, count(*)::BIGINT AS n FROM ks GROUP BY risk_type)
SELECT risk_type, cat_rank, n, round_even(n / sum(n) OVER (), 6) AS share,
round_even(sum(n) OVER (ORDER BY cat_rank ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS cumulative_share FROM c"""
    out["document_summary"] = f"""WITH {DOC_KW} SELECT doc_id, total_sentences, risky_count,
{PERCENT} AS risk_percentage, high, medium, low, n_transformer, n_ml, n_keyword FROM dall"""
    out["cascade_summary"] = f"""WITH {cascade('auto')},
r AS (SELECT doc_id, count(*)::BIGINT AS risky_count, {COUNTS}, {DETECTOR_COUNTS} FROM sc GROUP BY doc_id),
tot AS (SELECT doc_id, count(*)::BIGINT AS total_sentences FROM cl GROUP BY doc_id),
a AS (SELECT documents.doc_id, coalesce(total_sentences, 0) AS total_sentences, coalesce(risky_count, 0) AS risky_count,
  coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low,
  coalesce(n_transformer, 0) AS n_transformer, coalesce(n_ml, 0) AS n_ml, coalesce(n_keyword, 0) AS n_keyword
  FROM documents LEFT JOIN tot USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, total_sentences, risky_count, {PERCENT} AS risk_percentage, high, medium, low,
n_transformer, n_ml, n_keyword FROM a"""
    for name in ("analyze_report", "report_roundtrip", "stream_score"):
        out[name] = REPORT

    row = "sentence, label, source"
    out["merge_corpora"] = f"WITH {MERGED} SELECT sentence, label, seq, source, source_rank FROM merged"
    quoted = """'say "so", ' || sentence"""
    out["read_labeled"] = f"WITH {MERGED} SELECT {clean(quoted)} AS sentence, label, source FROM merged"
    out["read_labeled_mixed_headers"] = f"""WITH {MERGED} SELECT {clean('sentence')} AS sentence, label,
CASE WHEN source_rank <> 1 THEN source END AS source, source_rank = 2 AS noted FROM merged"""
    out["labelled_errors"] = f"""WITH {MERGED}, e AS (SELECT CASE WHEN seq % 7 = 0 OR {strip('sentence')} = '' THEN 'blank sentence'
  WHEN seq % 5 = 0 THEN 'blank label' END AS error FROM merged), k(error) AS (VALUES (NULL), ('blank sentence'), ('blank label'), ('other'))
SELECT k.error, count_if(e.error IS NOT DISTINCT FROM k.error)::BIGINT AS n FROM k, e GROUP BY 1"""
    out["corpus_partitions"] = f"WITH {MERGED} SELECT sentence, label, source FROM merged WHERE label <> 'Penalty' OR source_rank = 0"
    out["load_training_data"] = f"WITH {MERGED} SELECT {strip('sentence')} AS sentence, label FROM merged"
    out["first_seen_files"] = f"""WITH {MERGED} SELECT {clean('sentence')} AS sentence,
CASE WHEN bool_or(label = 'Penalty') THEN 'A' ELSE 'B' END AS label FROM merged GROUP BY 1"""
    out["balance_duplicate_keys"] = f"""WITH {MERGED}
SELECT sentence, label, source FROM merged QUALIFY row_number() OVER (PARTITION BY label ORDER BY
  md5(concat_ws('|', '42', source)), md5(concat_ws('|', '42', '=' || sentence, '=' || label, '=' || source))) <= 700"""
    out["corpus_roundtrip"] = f"WITH {MERGED} SELECT {row} FROM merged"
    out["label_counts"] = f"WITH {MERGED} SELECT label, count(*)::BIGINT AS n FROM merged GROUP BY label"
    out["dedup_first"] = f"WITH {MERGED} {first_seen('label', 'source')}"
    out["dedup_stats"] = f"""WITH {MERGED}
SELECT count(*)::BIGINT AS rows_before, count(DISTINCT sentence)::BIGINT AS rows_after FROM merged"""
    distinct = f"WITH {MERGED} SELECT DISTINCT sentence, label FROM merged"
    out["distinct_pairs"] = distinct
    out["conflicts_keep_all"] = distinct
    prefer = """SELECT sentence, label FROM merged QUALIFY row_number() OVER (
  PARTITION BY sentence ORDER BY label = 'None', source_rank, seq) = 1"""
    out["conflicts_prefer_non_none"] = f"WITH {MERGED} {prefer}"
    out["conflicts_majority"] = f"""WITH {MERGED},
votes AS (SELECT sentence, label, count(*) AS n, min((source_rank, seq)) AS seen FROM merged GROUP BY ALL)
SELECT sentence, label FROM votes QUALIFY row_number() OVER (PARTITION BY sentence ORDER BY n DESC, seen) = 1"""
    out["conflicts_majority_deduped"] = f"WITH {MERGED} {first_seen('label')}"
    cleaned = f"cleaned AS (SELECT {clean('sentence')} AS sentence, label, source_rank, seq FROM merged)"
    out["merged_training_corpus"] = f"""WITH {MERGED}, {cleaned}, res AS ({prefer.replace('FROM merged', 'FROM cleaned')}),
n AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM res GROUP BY label))
SELECT sentence, label FROM res QUALIFY row_number() OVER (
  PARTITION BY label ORDER BY md5(concat_ws('|', '42', sentence, label))) <= (SELECT n FROM n)"""
    out["balance_cap"] = capped("2000", row)
    out["balance_to_n"] = capped("1500", row)
    out["balance_min"] = capped("(SELECT min(n) FROM sizes)", row)
    out["sample_negatives"] = f"""WITH {MERGED},
r AS (SELECT *, row_number() OVER (ORDER BY {ROW_HASH}) AS rn FROM merged WHERE label = 'None')
SELECT sentence, source, seq FROM r
WHERE rn <= (SELECT floor(count(*) * {num(0.1)}) FROM merged WHERE label <> 'None')"""
    ranked = f"WITH {MERGED}, r AS (SELECT *, row_number() OVER (ORDER BY {ROW_HASH}) AS rn, count(*) OVER () AS n FROM merged)"
    out["seeded_limit"] = f"{ranked} SELECT sentence, label, seq FROM r WHERE rn <= 5000"
    out["random_split"] = f"{ranked} SELECT source, seq, rn <= floor(n * {num(0.9)}) AS is_train FROM r"
    out["stratified_split"] = f"""WITH {MERGED}, r AS (SELECT *,
  row_number() OVER (PARTITION BY label ORDER BY {ROW_HASH}) AS rn, count(*) OVER (PARTITION BY label) AS n FROM merged)
SELECT source, seq, label, rn <= floor(n * {num(0.25)} + {num(0.5)}) AS is_test FROM r"""
    out["label_index"] = f"""WITH {MERGED}
SELECT source, seq, label, dense_rank() OVER (ORDER BY label) - 1 AS label_idx FROM merged"""

    titles = array((*taxonomy.TITLE_TO_LABEL, *derive.UNMAPPED_TITLES))
    out["map_titles"] = f"""WITH {CLAUSES}, {mapping('tmap', taxonomy.TITLE_TO_LABEL, 'title', 'label')},
q AS (SELECT doc_id || '-' || sent_idx AS k, CASE WHEN h % 41 = 0 THEN '' ELSE ({titles})[h % 40 + 1] END AS title,
  {strip('sentence')} AS sentence FROM cl)
SELECT k || '__' || title AS id, sentence, label, 'cuad' AS source FROM q JOIN tmap USING (title)
WHERE length(sentence) > 20"""
    names = array((*taxonomy.PROVISION_TO_LABEL, *derive.UNMAPPED_PROVISIONS))
    out["map_provisions"] = f"""WITH {CLAUSES}, {mapping('pmap', taxonomy.PROVISION_TO_LABEL, 'name', 'label')},
q AS (SELECT {key}, ({names})[h % 30 + 1] AS name, {strip('sentence')} AS sentence FROM cl
  WHERE h % 43 <> 0 AND h % 37 <> 0)
SELECT {key}, sentence, label, 'ledgar' AS source FROM q JOIN pmap USING (name)"""
    question = f"concat_ws(' ', {predicate_sql('h')}, {tail_sql('h')})"
    out["question_category"] = f"WITH {CLAUSES} SELECT {key}, {question_category(question)} AS category FROM cl"
    out["wide_clause_unpivot"] = out["wide_clause_files"] = f"WITH {WIDE} SELECT doc_id, clause, label, text FROM wide"
    gone = array([c for c in WIDE_NAMES[:2]])
    out["wide_clause_mixed_files"] = f"""WITH {WIDE} SELECT doc_id, clause, label, text FROM wide
WHERE doc_id % 3 <> 1 OR NOT list_contains({gone}, clause)"""
    out["mapped_corpus"] = f"""WITH prov AS ({out['map_provisions']}), mer AS ({out['merge_corpora']}),
u AS (SELECT 0 AS rank, seq, sentence, label, source FROM mer WHERE source_rank = 0
  UNION ALL SELECT 1, doc_id * 1000000 + sent_idx, sentence, label, source FROM prov),
d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY sentence ORDER BY rank, seq) = 1)
SELECT sentence, label, source FROM d
QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', sentence))) <= 1000"""
    out["mine_negatives_wide"] = f"WITH {WIDE} SELECT sentence FROM wneg"
    out["build_corpus_wide"] = prepared(WIDE, "wpos", "wneg", 0.5)
    out["qa_json_flatten"] = f"""WITH {QA} SELECT md5(context) AS context_md5, question, label, answer
FROM ans JOIN para USING (doc_id)"""
    out["mine_negatives_qa"] = f"WITH {QA} SELECT sentence FROM qneg"
    out["mine_negatives_qa_indexed"] = out["mine_negatives_qa"]
    out["build_corpus_qa"] = prepared(QA, "qpos", "qneg", 0.5)

    out["concat_pages"] = """SELECT conv_id AS doc_id,
string_agg(CASE WHEN (conv_id + turn) % 9 <> 0 THEN coalesce(text, '') ELSE '' END, '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id"""
    out["ingest_files"] = """WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT source, 0::BIGINT AS n_errors, count_if(line <> '')::BIGINT AS n_lines,
sum(CASE WHEN line <> '' THEN ('0x' || substr(md5(line), 1, 8))::BIGINT END)::BIGINT AS digest FROM l GROUP BY source"""

    out["ece"] = f"WITH {PAIRS} SELECT round_even(sum(n * abs(conf / n - ok / n)) / sum(n), 4) AS ece FROM bins"
    out["reliability_bins"] = f"""WITH {PAIRS} SELECT bin, n, round_even(conf / n, 6) AS avg_confidence,
round_even(ok / n, 6) AS accuracy FROM bins"""
    out["classification_report"] = f"""WITH {PAIRS} SELECT label, round_even(precision, 6) AS precision,
round_even(recall, 6) AS recall, round_even(f1, 6) AS f1, support FROM report"""
    out["f1_summary"] = f"""WITH {PAIRS} SELECT round_even(sum(tp) / sum(support), 6) AS accuracy,
round_even(avg(f1), 6) AS macro_f1, round_even(sum(f1 * support) / sum(support), 6) AS weighted_f1,
sum(support)::BIGINT AS n FROM report"""
    out["class_weights"] = f"""WITH {MERGED}, c AS (SELECT label, count(*)::BIGINT AS n FROM merged GROUP BY label)
SELECT label, n, round_even(sum(n) OVER () / (count(*) OVER () * n), 9) AS weight FROM c"""

    out["tfidf_vocab"] = f"WITH {TFIDF} SELECT term, term_idx, cf, df, round_even(idf, 6) AS idf FROM vocab"
    out["tfidf"] = f"""WITH {TFIDF} SELECT {key}, count(*)::BIGINT AS n_terms, round_even(sum(weight), 6) AS weight_sum,
round_even(max(weight), 6) AS weight_max FROM weights GROUP BY ALL"""

    out["stream_severity_windows"] = f"""WITH e AS (SELECT ts, event_id * 17 AS h FROM events),
f AS (SELECT ts, lower({fragment_sql('h')}) AS l FROM e),
t AS (SELECT *, {keyword('l')} AS risk_type, NULL::DOUBLE AS confidence FROM f),
hit AS (SELECT * FROM t WHERE risk_type IS NOT NULL),
{scored('sc', 'hit', '*')}
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, severity, count(*)::BIGINT AS n FROM sc GROUP BY ALL"""
    out["stream_final_windows"] = out["stream_severity_windows"]
    out["train_ml"] = f"""WITH s AS ({out['stratified_split']})
SELECT label, count(*)::BIGINT AS support, 0::BIGINT AS mismatches, true AS beats_majority FROM s WHERE is_test GROUP BY label"""
    out["ml_predict"] = f"""WITH m AS ({out['merge_corpora']})
SELECT source_rank::BIGINT AS source_rank, seq, true AS known_label, true AS in_range, false AS as_blank FROM m
UNION ALL SELECT -1, -1, true, false, true"""
    return out
