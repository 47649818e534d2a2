"""DuckDB SQL with the same results as the catalogue, written independently of the Spark code."""

from __future__ import annotations

from feedlens import constants as K
from feedlens.operators import prompt as P
from feedlens.plans.tables import CRITERIA, OFFSETS

W = r"[\p{L}\p{N}_]+"
PUNCT = K.PUNCTUATION.replace("'", "''")
GATES = [0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5]


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, '{K.WS_CHARS}')"


def key(x: str) -> str:
    bare = f"regexp_replace(translate(lower(coalesce({x}, '')), '{PUNCT}', ''), '{K.WS}+', ' ', 'g')"
    return strip(bare)


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{W}')"


def first_words(x: str) -> str:
    return f"array_to_string(list_slice(regexp_split_to_array({strip(x)}, '{K.WS}+'), 1, 4), ' ')"


def hexnum(x: str, digits: int, kind: str = "BIGINT", at: int = 1) -> str:
    return f"CAST('0x' || substr(md5({x}), {at}, {digits}) AS {kind})"


def dot(a: str, b: str) -> str:
    return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def fixed(x: str, digits: int) -> str:
    return f"printf('%.{digits}f', CAST({x} AS DOUBLE))"


def exact_rounding(sql: str) -> str:
    """Replace round_even(x, n) by printing: that rounds the exact binary value, ties to even."""
    while (at := sql.find("round_even(")) >= 0:
        depth, i, comma = 1, at + len("round_even("), 0
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            comma = i if sql[i] == "," and depth == 1 else comma
            i += 1
        value, digits = sql[at + len("round_even(") : comma], sql[comma + 1 : i - 1].strip()
        sql = f"{sql[:at]}CAST(printf('%.{digits}f', CAST({value} AS DOUBLE)) AS DOUBLE){sql[i:]}"
    return sql


TICKETS = """
t AS (SELECT doc_id AS pos, CAST(doc_id AS VARCHAR) AS ticket_id, lang AS topic, text AS message,
      'Topic: ' || coalesce(lang, '') || ' | Message: ' || coalesce(text, '') AS etext FROM documents)"""

TFIDF = f"""{TICKETS},
tf AS (SELECT pos, {hexnum('w', 8)} % 262144 AS f, count(*) AS c
       FROM (SELECT pos, unnest({words('etext')}) AS w FROM t) GROUP BY 1, 2),
df AS (SELECT f, count(*) AS d FROM tf GROUP BY 1),
nd AS (SELECT count(*) AS n FROM t),
dw AS (SELECT pos, f, c * (1 + ln((1.0 + n) / (1.0 + d))) AS w FROM tf JOIN df USING (f) CROSS JOIN nd),
dv AS (SELECT pos, f, w / l AS w FROM dw JOIN (SELECT pos, sqrt(sum(w * w)) AS l FROM dw GROUP BY 1) USING (pos))"""


def queries_cte(source: str) -> str:
    """Vectors of the rows (pid, text) of ``source`` in the ticket feature space."""
    return f"""
qf AS (SELECT pid, {hexnum('w', 8)} % 262144 AS f, count(*) AS c
       FROM (SELECT pid, unnest({words('text')}) AS w FROM {source}) GROUP BY 1, 2),
qw AS (SELECT pid, f, c * (1 + ln((1.0 + n) / (1.0 + coalesce(d, 0)))) AS w FROM qf LEFT JOIN df USING (f) CROSS JOIN nd),
qv AS (SELECT pid, f, w / l AS w FROM qw JOIN (SELECT pid, sqrt(sum(w * w)) AS l FROM qw GROUP BY 1) USING (pid))"""


def topk(scores: str, k: int, threshold: float = 0.2) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY s DESC, pos DESC) AS rank
       FROM ({scores}) WHERE s >= {threshold}) WHERE rank <= {k}"""


ITEMS = "(SELECT item_id AS pid, text FROM benchmark)"
SCORES = "SELECT pid, pos, round(sum(qv.w * dv.w), 9) AS s FROM qv JOIN dv USING (f) GROUP BY 1, 2"
EVIDENCE = f"""{TFIDF}, {queries_cte(ITEMS)},
ev AS ({topk(SCORES, 5)}),
gc AS (SELECT item_id AS pid, count(s) AS retrieved, count(s) FILTER (s >= 0.3) AS validated
       FROM benchmark LEFT JOIN ev ON pid = item_id GROUP BY 1)"""

SEVERE = "|".join(K.SEVERITY_KEYWORDS).replace("'", "''")


def factors(kept: str) -> str:
    """Factor points of the validated tickets (pid, pos, s) of ``kept``."""
    return f"""
ft AS (SELECT pid, n, m, least(30.0, 6 * ss) AS ticket_volume, least(20.0, 4 * sev) AS severity,
        CASE WHEN chars >= 30 THEN 25.0 WHEN chars >= 15 THEN 18.0 ELSE 10.0 END * m AS sentiment_consistency,
        CASE WHEN dated THEN 15.0 ELSE 10.0 END * m AS recency, round_even(ids / n * 10.0 * m, 1) AS diversity
  FROM (SELECT pid, count(*) AS n, avg(least(1.0, greatest(0.0, s))) AS m, sum(least(1.0, greatest(0.0, s))) AS ss,
          coalesce(sum(s) FILTER (regexp_matches(lower(message), '{SEVERE}')), 0.0) AS sev,
          avg(length({strip('message')})) AS chars, bool_or(ts IS NOT NULL) AS dated, count(DISTINCT ticket_id) AS ids
        FROM {kept} JOIN t USING (pos) LEFT JOIN events ON event_id = pos GROUP BY 1)),
sc AS (SELECT item_id AS pid, coalesce(n, 0) AS validated, gc.retrieved AS retrieved, round_even(coalesce(m, 0.0), 2) AS average_similarity,
    round_even(coalesce(ticket_volume, 0.0), 1) AS ticket_volume, round_even(coalesce(severity, 0.0), 1) AS severity,
    round_even(coalesce(sentiment_consistency, 0.0), 1) AS sentiment_consistency,
    round_even(coalesce(recency, 0.0), 1) AS recency, round_even(coalesce(diversity, 0.0), 1) AS diversity,
    CAST(greatest(0, least(round_even(coalesce(ticket_volume + sentiment_consistency + severity + recency + diversity, 0.0), 0),
      CASE n WHEN 1 THEN 39 WHEN 2 THEN 69 ELSE 100 END)) AS BIGINT) AS score,
    CASE WHEN n IS NULL THEN 'Zero' WHEN n <= 2 THEN 'Small' WHEN n < 6 THEN 'Medium' ELSE 'Large' END AS sample_size
  FROM benchmark LEFT JOIN ft ON pid = item_id JOIN gc ON gc.pid = item_id),
sd AS (SELECT *, CASE WHEN score < 40 THEN 'Low' WHEN score < 70 THEN 'Moderate' ELSE 'High' END AS confidence FROM sc)"""


SUMMARY = (
    "'Confidence Level: ' || confidence || chr(10) || 'Evidence Score: ' || score || ' / 100' || chr(10)"
    " || 'Evidence Telemetry:' || chr(10) || '- Validated Tickets: ' || validated || chr(10)"
    " || '- Retrieved Candidates: ' || retrieved || chr(10)"
    " || '- Rejected Candidates: ' || greatest(0, retrieved - validated) || chr(10)"
    f" || '- Average Similarity: ' || {fixed('average_similarity', 2)} || chr(10)"
    " || '- Sample Size Tier: ' || sample_size || chr(10) || 'Factor Breakdown:' || chr(10)"
    " || '- Ticket Volume: ' || ticket_volume || ' / 30 pts' || chr(10)"
    " || '- Severity & Urgency: ' || severity || ' / 20 pts' || chr(10)"
    " || '- Sentiment Consistency: ' || sentiment_consistency || ' / 25 pts' || chr(10)"
    " || '- Recency: ' || recency || ' / 15 pts' || chr(10) || '- User Diversity: ' || diversity || ' / 10 pts'"
)


def level_of(id: str, shift: int) -> str:
    names = "[" + ", ".join(f"'{c}'" for c in CRITERIA) + "]"
    name = f"{names}[(({id}) + {shift}) % 5 + 1]"
    return f"(CASE {name} WHEN 'Low' THEN 1.5::DOUBLE WHEN 'Medium' THEN 3.0 WHEN 'High' THEN 4.5 ELSE 5.0 END)"


def decided(source: str) -> str:
    """Decision CTEs over (pid, ev, eff, imp, ali, cost, risk, sample_size, dup) of ``source``."""
    rule = """CASE WHEN ev = 0 THEN 'none' WHEN risk >= 4.5 AND ev < 40 AND ali <= 2 THEN 'reject'
      WHEN imp >= 4 AND ev < 70 THEN 'impact'
      WHEN eff >= 4 AND (risk >= 3.5 OR cost >= 3.5) AND ev BETWEEN 40 AND 75 THEN 'spike'
      WHEN ev >= 70 AND pri >= 50 AND risk <= 4 THEN 'build' WHEN ev < 40 AND imp <= 3 THEN 'modest'
      WHEN eff >= 4 AND ali <= 2.5 THEN 'misaligned' WHEN pri >= 60 THEN 'favorable'
      WHEN pri >= 40 THEN 'borderline' ELSE 'suboptimal' END"""
    action = """CASE rule WHEN 'none' THEN 'INSUFFICIENT_EVIDENCE' WHEN 'reject' THEN 'REJECT' WHEN 'impact' THEN 'VALIDATE_FURTHER'
      WHEN 'spike' THEN 'PROTOTYPE_OR_SPIKE' WHEN 'build' THEN 'PROCEED_TO_BUILD' WHEN 'favorable' THEN 'PROCEED_TO_BUILD'
      WHEN 'borderline' THEN 'VALIDATE_FURTHER' ELSE 'DEPRIORITIZE' END"""
    return f"""
d0 AS (SELECT *, (0.35::DOUBLE * ev + 0.30::DOUBLE * ((imp - 1) / 4 * 100) + 0.15::DOUBLE * ((ali - 1) / 4 * 100)) AS gains,
         (0.10::DOUBLE * ((eff - 1) / 4 * 100) + 0.05::DOUBLE * ((cost - 1) / 4 * 100) + 0.05::DOUBLE * ((risk - 1) / 4 * 100)) AS drags FROM {source}),
d1 AS (SELECT *, CAST(round_even(greatest(0.0, least(100.0, gains - drags + 20.0)), 0) AS BIGINT) AS pri FROM d0),
d2 AS (SELECT *, {rule} AS rule FROM d1),
dc AS (SELECT *, {action} AS recommendation, CASE WHEN pri >= 80 THEN 'Top Priority' WHEN pri >= 60 THEN 'Strong Candidate'
         WHEN pri >= 40 THEN 'Conditional' WHEN pri >= 20 THEN 'Low Priority' ELSE 'Unfavorable' END AS decision_tier FROM d2)"""


def sentence(text: str) -> str:
    out = q(text)
    for name, value in {
        "ev": fixed("ev", 0), "pri": "CAST(pri AS VARCHAR)", "imp": fixed("imp", 1), "eff": fixed("eff", 1),
        "risk": fixed("risk", 1), "cost": fixed("cost", 1), "dup": "CAST(dup AS VARCHAR)",
    }.items():
        if "{" + name + "}" in text:
            out = f"replace({out}, '{{{name}}}', {value})"
    return out


def lines(items: list[tuple[str, str]], default: str | None = None) -> str:
    parts = ", ".join(f"CASE WHEN {when} THEN {sentence(text)} END" for when, text in items)
    joined = f"concat_ws(' / ', {parts})"
    return f"coalesce(nullif({joined}, ''), {q(default)})" if default else joined


RATIONALE = "CASE rule " + " ".join(
    f"WHEN '{rule}' THEN concat_ws(' / ', {', '.join(sentence(s) for s in texts)})" for rule, texts in K.RATIONALE.items()
) + " END"
ASSUMPTIONS = lines([("TRUE", K.ASSUMPTIONS["effort"]), ("TRUE", K.ASSUMPTIONS["impact"]), ("dup > 0", K.ASSUMPTIONS["duplicates"])])
RISKS = lines(
    [("risk >= 3.5", K.RISKS["execution"]), ("eff >= 4", K.RISKS["opportunity"]), ("cost >= 3.5", K.RISKS["financial"]),
     ("ev < 50", K.RISKS["market"])], K.RISKS["default"],
)
TRADES = lines(
    [("imp >= 4 AND eff >= 4", K.TRADE_OFFS["both_high"]), ("imp >= 4 AND eff <= 2", K.TRADE_OFFS["quick_win"]),
     ("imp <= 2 AND eff >= 3.5", K.TRADE_OFFS["low_value"]), ("ev >= 70 AND ali <= 2.5", K.TRADE_OFFS["off_strategy"])],
    K.TRADE_OFFS["default"],
)
MISSING = lines(
    [("ev < 70", K.MISSING["analytics"]), ("ev < 70", K.MISSING["interviews"]),
     ("sample_size IN ('Zero', 'Small')", K.MISSING["sample"]), ("TRUE", K.MISSING["spec"])]
)

CRITERIA_OF_DOC = ", ".join(
    f"{level_of(f'doc_id + n_chars * {s + 1}', s)} AS {name}"
    for name, s in zip(["eff", "imp", "ali", "cost", "risk"], OFFSETS.values())
)
DOC_DECISIONS = f"""WITH dd AS (SELECT doc_id AS pid, n_chars % 101 AS ev, {CRITERIA_OF_DOC},
  CASE WHEN n_chars % 8 = 0 THEN 'Zero' WHEN n_chars % 8 <= 2 THEN 'Small' WHEN n_chars % 8 < 6 THEN 'Medium' ELSE 'Large' END AS sample_size,
  n_chars % 3 AS dup FROM documents), {decided('dd')}"""

# --- duplicates ---------------------------------------------------------------------

KEYED = f"""{TICKETS}, k AS (SELECT *, {key('topic')} || '||' || {key('message')} AS k FROM t),
c AS (SELECT *, min(pos) OVER (PARTITION BY k) AS component FROM k)"""


def groups(members: str, preference: str, by: str = "") -> str:
    """Group rows from members (component, pos, ticket_id, k) of ``members``."""
    return f"""m AS (SELECT *, row_number() OVER (PARTITION BY {by}component ORDER BY {preference}, pos) AS rn,
   count(*) OVER (PARTITION BY {by}component) AS group_size FROM {members}),
r AS (SELECT m.*, x.ticket_id AS rep, x.k AS rep_k FROM m JOIN m x ON {'m.pid = x.pid AND ' if by else ''}x.component = m.component AND x.rn = 1)"""


GROUP_ROWS = """SELECT component, any_value(rep) AS representative_ticket_id, count(*) AS group_size,
  bool_or(rn > 1 AND k = rep_k) AS has_exact, bool_or(rn > 1 AND k <> rep_k) AS has_semantic FROM r WHERE group_size > 1 GROUP BY 1"""


def stats(by: str = "", source: str = "r") -> str:
    head = f"{by}, " if by else ""
    tail = f"GROUP BY {by}" if by else ""
    return f"""SELECT {head}count(*) AS total_input_count, count(*) FILTER (rn = 1) AS unique_count, count(*) FILTER (rn > 1) AS duplicate_count,
  round_even(count(*) FILTER (rn > 1) / count(*), 4) AS duplicate_rate, count(*) FILTER (rn > 1 AND k = rep_k) AS exact_duplicates_count,
  count(*) FILTER (rn > 1 AND k <> rep_k) AS semantic_duplicates_count FROM {source} {tail}"""


def semantic(threshold: float, name: str = "") -> str:
    """Components of equal keys and similar texts over all documents, by label spreading."""
    return f"""
sp AS MATERIALIZED (SELECT x.pos AS a, y.pos AS b, round(sum(x.w * y.w), 9) AS s FROM dv x JOIN dv y ON x.f = y.f AND x.pos < y.pos
       GROUP BY 1, 2 HAVING round(sum(x.w * y.w), 9) >= {threshold})"""


def reach(edges: str, nodes: str = "k", group: str = "") -> str:
    g, both = (f"{group}, ", f"e.{group} = x.{group} AND ") if group else ("", "")
    return f"""
e AS (SELECT {g}a, b FROM {edges} UNION SELECT {g}b, a FROM {edges}),
x AS (SELECT {g}a AS node, a AS low FROM e UNION SELECT {'x.' + g if g else ''}x.node, e.b FROM x JOIN e ON {both}e.a = x.low),
parts AS (SELECT {g}node, min(low) AS component FROM x GROUP BY ALL)"""


EXACT_EDGES = "SELECT pos AS a, component AS b FROM c WHERE pos <> component"
SEMANTIC_MEMBERS = f"""WITH RECURSIVE {TFIDF}, k AS (SELECT *, {key('topic')} || '||' || {key('message')} AS k FROM t),
c AS (SELECT *, min(pos) OVER (PARTITION BY k) AS component FROM k), {semantic(0.85)},
ed AS ({EXACT_EDGES} UNION SELECT a, b FROM sp), {reach('ed')},
mm AS (SELECT k.*, coalesce(component, pos) AS component FROM k LEFT JOIN parts ON node = pos),
{groups('mm', 'length(message) DESC')}"""

# annotated pairs: neighbours, and copies with the first of their text
ANNOTATED = f"""dk AS (SELECT doc_id AS d, {key('text')} AS k FROM documents),
ap AS (SELECT CAST(a AS VARCHAR) AS ticket_a, CAST(b AS VARCHAR) AS ticket_b, bool_or(dup) AS is_duplicate FROM (
  SELECT x.d AS a, y.d AS b, x.k = y.k AS dup FROM dk x JOIN dk y ON y.d = x.d + 1
  UNION ALL SELECT m, d, TRUE FROM (SELECT d, min(d) OVER (PARTITION BY k) AS m FROM dk) WHERE d <> m) GROUP BY 1, 2)"""
PAIR_TEXTS = f"""{ANNOTATED}, pt AS (SELECT ap.*, x.text AS ma, y.text AS mb, x.lang AS ta, y.lang AS tb FROM ap
  LEFT JOIN documents x ON CAST(x.doc_id AS VARCHAR) = ticket_a LEFT JOIN documents y ON CAST(y.doc_id AS VARCHAR) = ticket_b)"""


def overlap(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    total = f"(len(list_distinct({a})) + len(list_distinct({b})) - {both})"
    return f"CASE WHEN {total} = 0 THEN 1.0 ELSE {both} / {total} END"


JACCARD = f"(SELECT ticket_a, ticket_b, {overlap('wa', 'wb')} AS jaccard FROM (SELECT *, {words('ma')} AS wa, {words('mb')} AS wb FROM pt))"


def clean(x: str) -> str:
    return f"regexp_replace({strip(f'lower({x})')}, '{K.WS}+', ' ', 'g')"


def grams(x: str) -> str:
    return f"list_transform(range(1, length({x}) - 1), lambda i: substr({x}, i, 3))"


TRIGRAM = f"""(SELECT ticket_a, ticket_b, CASE WHEN length(ca) < 3 OR length(cb) < 3 THEN CASE WHEN ca = cb THEN 1.0 ELSE 0.0 END
  ELSE {overlap('ga', 'gb')} END AS trigram FROM (SELECT *, {grams('ca')} AS ga, {grams('cb')} AS gb
  FROM (SELECT *, {clean('ma')} AS ca, {clean('mb')} AS cb FROM pt)))"""


def confusion(by: str = "") -> str:
    head, tail = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT {head}count(*) FILTER (is_duplicate AND predicted) AS tp, count(*) FILTER (NOT is_duplicate AND predicted) AS fp,
  count(*) FILTER (is_duplicate AND NOT predicted) AS fn, count(*) FILTER (NOT is_duplicate AND NOT predicted) AS tn FROM judged {tail}"""


RATES = """precision_ AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r FROM cm)"""
F1 = "round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1_score"
COUNTS = "tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives"
JUDGED = """judged AS (SELECT ap.*, coalesce(x.component = y.component, FALSE) AND (x.rn = 1 OR y.rn = 1) AS predicted
  FROM ap LEFT JOIN r x ON x.ticket_id = ticket_a LEFT JOIN r y ON y.ticket_id = ticket_b)"""
PAIR_COSINE = """pc AS (SELECT ticket_a, ticket_b, round(coalesce(sum(x.w * y.w), 0), 9) AS cosine FROM ap
  LEFT JOIN dv x ON CAST(x.pos AS VARCHAR) = ticket_a LEFT JOIN dv y ON CAST(y.pos AS VARCHAR) = ticket_b AND x.f = y.f GROUP BY 1, 2)"""

# --- vectors ---------------------------------------------------------------------------

CELLS = "ce AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)"
SUMS = f"{CELLS}, su AS (SELECT label, list(s ORDER BY i) AS total FROM (SELECT label, i, sum(CAST(v AS DOUBLE)) AS s FROM ce GROUP BY 1, 2) GROUP BY 1)"
SIZES = "sz AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)"
VECTOR_PAIRS = f"vp AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b, round({dot('x.embedding', 'y.embedding')}, 9) AS s FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id)"


def ranked(k: int, vec: str = "embedding", suffix: str = "") -> str:
    """Every vector against all others: hits within the k best, and relevant counts."""
    return f"""rk{suffix} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, d DESC) AS rank FROM (
    SELECT x.vec_id AS q, y.vec_id AS d, x.label = y.label AS hit, round({dot(f'x.{vec}', f'y.{vec}')}, 9) AS s
    FROM ve{suffix} x JOIN ve{suffix} y ON x.vec_id <> y.vec_id) WHERE s >= 0.2) WHERE rank <= {k}),
ru{suffix} AS (SELECT *, sum(CAST(hit AS INT)) OVER (PARTITION BY q ORDER BY rank) AS seen FROM rk{suffix}),
ir{suffix} AS (SELECT vec_id AS query_id, count(rank) AS retrieved_count, count(*) FILTER (hit) AS relevant_in_top_k, any_value(n) - 1 AS total_relevant,
   count(*) FILTER (hit) / {k}.0 AS precision_at_k, count(*) FILTER (hit) / (any_value(n) - 1) AS recall_at_k,
   coalesce(1.0 / min(rank) FILTER (hit), 0.0) AS reciprocal_rank,
   coalesce(sum(seen / rank) FILTER (hit), 0.0) / least({k}, any_value(n) - 1) AS average_precision
  FROM ve{suffix} v JOIN sz USING (label) LEFT JOIN ru{suffix} ON q = vec_id WHERE n > 1 GROUP BY 1)"""


VE = "ve AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"
MACRO = """count(*) AS queries_evaluated, round_even(avg(precision_at_k), 4) AS precision_at_k, round_even(avg(recall_at_k), 4) AS recall_at_k,
  round_even(avg(reciprocal_rank), 4) AS mrr, round_even(avg(average_precision), 4) AS map"""

# --- calibration --------------------------------------------------------------------------

RECORDS = """oc AS (SELECT doc_id AS record_id, CAST(quality AS DOUBLE) AS y, doc_id AS event_id FROM labels
   UNION ALL SELECT doc_id, CAST(1 - toxic AS DOUBLE), doc_id * 5 + 3 FROM labels),
lo AS (SELECT record_id, y AS actual_outcome FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ts DESC, y DESC) AS rn
   FROM oc LEFT JOIN events USING (event_id)) WHERE rn = 1),
re AS (SELECT doc_id AS record_id, n_chars % 101 AS score, (n_chars % 101) / 100.0 AS p, actual_outcome AS y,
   CASE WHEN n_chars % 101 < 40 THEN 'Low' WHEN n_chars % 101 < 70 THEN 'Moderate' ELSE 'High' END AS tier
   FROM documents LEFT JOIN lo ON record_id = doc_id)"""
BINS = """bi AS (SELECT i, i * (1.0::DOUBLE / 5) AS lo, CASE WHEN i = 4 THEN 1.0::DOUBLE ELSE (i + 1) * (1.0::DOUBLE / 5) END AS hi FROM range(5) g(i)),
bt AS (SELECT i, lo, hi, count(y) AS n, sum(score) FILTER (y IS NOT NULL) / (count(y) * 100.0::DOUBLE) AS p, avg(y) AS y
   FROM bi LEFT JOIN re ON y IS NOT NULL AND p >= lo AND (p < hi OR (i = 4 AND p <= hi)) GROUP BY 1, 2, 3)"""
CALIB = f"""{RECORDS}, {BINS}, ca AS (SELECT count(*) AS total_records, count(y) AS evaluated_records, count(*) - count(y) AS pending_records,
   avg((p - y) * (p - y)) AS brier, (SELECT sum(n * abs(y - p)) FROM bt) / count(y) AS ece, sum(score) FILTER (y IS NOT NULL) / (count(y) * 100.0::DOUBLE) - avg(y) AS bias,
   avg(CAST((p >= 0.5) = (y >= 0.5) AS INT)) FILTER (y IS NOT NULL) AS accuracy FROM re),
cs AS (SELECT total_records, evaluated_records, pending_records, round_even(brier, 4) AS brier_score, round_even(ece, 4) AS expected_calibration_error,
   round_even(bias, 4) AS calibration_bias, round_even(accuracy, 3) AS overall_accuracy,
   CASE WHEN evaluated_records = 0 THEN 'INSUFFICIENT_DATA' WHEN ece < 0.15 THEN 'CALIBRATED' ELSE 'CALIBRATION_DRIFT' END AS status FROM ca)"""

# --- evidence of the flagship: duplicates within each proposal --------------------------------

PROPOSAL_LEVELS = ", ".join(f"{level_of('item_id', s)} AS {n}" for n, s in zip(["eff", "imp", "ali", "cost", "risk"], OFFSETS.values()))
DECISION_RUN = f"""WITH RECURSIVE {EVIDENCE},
kv AS (SELECT ev.pid, ev.rank, ev.pos, ev.s, t.ticket_id, t.message, {key('t.topic')} || '||' || {key('t.message')} AS k FROM ev JOIN t USING (pos) WHERE ev.s >= 0.3),
ps AS (SELECT x.pid, x.rank AS a, y.rank AS b, round(sum(u.w * v.w), 9) AS s FROM kv x JOIN kv y ON x.pid = y.pid AND x.rank < y.rank
   JOIN dv u ON u.pos = x.pos JOIN dv v ON v.pos = y.pos AND u.f = v.f GROUP BY 1, 2, 3),
ed AS (SELECT pid, a, b FROM ps WHERE s >= 0.85 UNION SELECT x.pid, x.rank, y.rank FROM kv x JOIN kv y ON x.pid = y.pid AND x.rank < y.rank AND x.k = y.k),
{reach('ed', group='pid')},
mm AS (SELECT kv.*, coalesce(component, rank) AS component FROM kv LEFT JOIN parts ON parts.pid = kv.pid AND node = rank),
m AS (SELECT *, row_number() OVER (PARTITION BY pid, component ORDER BY length(message) DESC, rank) AS rn FROM mm),
r AS (SELECT m.*, x.k AS rep_k FROM m JOIN m x ON m.pid = x.pid AND x.component = m.component AND x.rn = 1),
un AS (SELECT pid, pos, s FROM r WHERE rn = 1), {factors('un')},
ds AS (SELECT item_id AS pid, count(rn) AS total_input_count, count(*) FILTER (rn = 1) AS unique_count, count(*) FILTER (rn > 1) AS dup,
   count(*) FILTER (rn > 1 AND k = rep_k) AS exact_duplicates_count, count(*) FILTER (rn > 1 AND k <> rep_k) AS semantic_duplicates_count
   FROM benchmark LEFT JOIN r ON r.pid = item_id GROUP BY 1),
dd AS (SELECT item_id AS pid, sd.score AS ev, {PROPOSAL_LEVELS}, sample_size, dup FROM benchmark JOIN sd ON sd.pid = item_id JOIN ds ON ds.pid = item_id),
{decided('dd')}"""

EVIDENCE_PROMPT = q(P.EVIDENCE_TEMPLATE)
for _name, _value in {
    "{proposal}": strip("text"), "{scoring_summary}": SUMMARY, "{tickets_text}": f"coalesce(tk, {q(P.NO_TICKETS)})",
}.items():
    # cut the template at the placeholder instead of replacing, so that ticket texts are never searched
    _left, _, _right = EVIDENCE_PROMPT.partition(_name)
    EVIDENCE_PROMPT = f"{_left}' || {_value} || '{_right}"

ORACLE: dict[str, str] = {
    "q_normalize_tickets": f"""SELECT CAST(row_number() OVER (ORDER BY conv_id, turn) AS VARCHAR) AS ticket_id, CAST(NULL AS VARCHAR) AS created_at,
      {first_words('text')} AS topic, {strip('text')} AS message FROM conversations WHERE {strip("coalesce(text, '')")} <> ''""",
    "q_adapt_support_tickets": f"""SELECT CAST(doc_id AS VARCHAR) AS ticket_id, '' AS created_at, {strip("coalesce(source, 'General Feedback')")} AS topic,
      md5({strip('text')}) AS message_md5 FROM documents WHERE {strip("coalesce(text, '')")} <> ''""",
    "q_adapt_app_reviews": f"""SELECT CAST(doc_id AS VARCHAR) AS ticket_id, '' AS created_at, 'App Review (Rating ' || (quality * 4 + 1) || '/5)' AS topic,
      md5({strip('text')}) AS message_md5 FROM labels JOIN documents USING (doc_id) WHERE {strip("coalesce(text, '')")} <> ''""",
    "q_adapt_issues": f"""SELECT 'GH-' || doc_id AS ticket_id, '' AS created_at, {strip("coalesce(source, 'General Feedback')")} AS topic,
      md5({strip('text')}) AS message_md5 FROM documents WHERE {strip("coalesce(text, '')")} <> ''""",
    "q_adapt_product_reviews": f"""SELECT concat_ws('_', source, CAST(doc_id AS VARCHAR)) AS ticket_id, '' AS created_at,
      {strip("coalesce(lang, 'General Feedback')")} AS topic, md5({strip('text')}) AS message_md5 FROM documents WHERE {strip("coalesce(text, '')")} <> ''""",
    "q_export_support_desk": """SELECT CAST(doc_id AS VARCHAR) AS ticket_id, '2024-05-01T00:00:00Z' AS created_at, coalesce(lang, '') AS topic,
      md5(coalesce(text, '')) AS message_md5 FROM documents""",
    "q_export_conversations": """SELECT conv_id || '-' || turn AS ticket_id, CASE WHEN turn % 2 = 0 THEN 'about ' || role ELSE role END AS topic,
      md5(coalesce(text, '')) AS message_md5 FROM conversations""",
    "q_export_page_properties": """SELECT CAST(page_id AS VARCHAR) AS page_id, url AS "Name", CAST(length(html) AS VARCHAR) AS "Size",
      'page, ' || page_id % 3 AS "Tags", CASE WHEN page_id % 2 = 0 THEN 'true' ELSE 'false' END AS "Done", 'web' AS "Kind", md5(html) AS body_md5 FROM pages""",
    "q_wrapped_records": """WITH r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS "at", turn, role, md5(text) AS text FROM conversations),
      k AS (SELECT * FROM r WHERE conv_id % 3 < 2 OR "at" = 0)
      SELECT conv_id, "at", 'turn' AS key, CAST(turn AS VARCHAR) AS value FROM k UNION ALL SELECT conv_id, "at", 'role', role FROM k UNION ALL SELECT conv_id, "at", 'text', text FROM k""",
    "q_landed_exports": f"""SELECT 'desk' AS part, CAST(doc_id AS VARCHAR) AS ticket_id, {strip("coalesce(lang, '')")} AS topic, md5({strip('text')}) AS message_md5
      FROM documents WHERE {strip("coalesce(text, '')")} <> ''
      UNION ALL SELECT 'sheet', CAST(doc_id AS VARCHAR), {strip("coalesce(source, 'General Feedback')")}, md5({strip('text')}) FROM documents WHERE {strip("coalesce(text, '')")} <> ''""",
    "q_landed_files": f"""WITH b AS (SELECT {strip("regexp_replace(text, '[' || chr(13) || chr(10) || ']+', ' ', 'g')")} AS m FROM benchmark)
      SELECT 'files' AS part, CAST(conv_id * 1000 + turn AS VARCHAR) AS ticket_id, {strip("coalesce(role, 'General Feedback')")} AS topic, md5({strip('text')}) AS message_md5
      FROM conversations WHERE {strip("coalesce(text, '')")} <> ''
      UNION ALL SELECT 'files', NULL, {first_words('m')}, md5(m) FROM b WHERE coalesce(m, '') <> '' AND m NOT LIKE '#%'""",
    "q_landed_datasets": f"""WITH d AS (SELECT * FROM documents WHERE {strip("coalesce(text, '')")} <> '')
      SELECT r.*, (SELECT 2 * count(*) FROM d) AS positions FROM (
        SELECT 'support' AS dataset, CAST(doc_id AS VARCHAR) AS ticket_id, '' AS created_at, {strip("coalesce(source, 'General Feedback')")} AS topic, md5({strip('text')}) AS message_md5 FROM d
        UNION ALL SELECT 'issues', 'GH-' || doc_id, '', {strip("coalesce(lang, 'General Feedback')")}, md5({strip('text')}) FROM d) r""",
    "q_parse_time": """SELECT event_id, CAST(CASE event_id % 6 WHEN 2 THEN epoch(date_trunc('day', ts)) WHEN 4 THEN epoch(date_trunc('second', ts)) - 7200
      WHEN 5 THEN NULL ELSE epoch(date_trunc('second', ts)) END AS BIGINT) AS seconds FROM events""",
    "q_event_properties": """SELECT key, count(*) AS n, count(DISTINCT value) AS distinct_values FROM (
      SELECT k AS key, json_extract_string(props, '$.' || k) AS value FROM (SELECT props, unnest(json_keys(props)) AS k FROM events)) GROUP BY 1""",
    "q_exact_key_groups": f"WITH {KEYED} SELECT component, count(*) AS group_size, max(pos) AS last_pos FROM c GROUP BY 1 HAVING count(*) > 1",
    "q_exact_dedup_longest": f"WITH {KEYED}, {groups('c', 'length(message) DESC')} {GROUP_ROWS}",
    "q_exact_dedup_earliest": f"WITH {KEYED}, ct AS (SELECT c.*, ts FROM c LEFT JOIN events ON event_id = pos), {groups('ct', 'ts ASC NULLS LAST')} {GROUP_ROWS}",
    "q_exact_dedup_stats": f"WITH {KEYED}, {groups('c', 'length(message) DESC')} {stats('topic')}",
    "q_md5_fingerprint": f"""SELECT lang AS topic, count(*) AS tickets, 
      CAST(sum({hexnum("coalesce(lang, '') || '||' || coalesce(text, '')", 16, 'HUGEINT')}
               + {hexnum("coalesce(lang, '') || '||' || coalesce(text, '')", 16, 'HUGEINT', 17)}) AS VARCHAR) AS fingerprint
      FROM documents GROUP BY 1""",
    # a tree of fan-out 1024: one level up to 1024 rows, two up to a million
    "q_ordered_fingerprint": f"""WITH {TICKETS}, l0 AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS i, md5(etext) AS h FROM t),
      l1 AS (SELECT i // 1024 AS i, md5(string_agg(h, '' ORDER BY i)) AS h FROM l0 GROUP BY i // 1024),
      l2 AS (SELECT md5(string_agg(h, '' ORDER BY i)) AS h, count(*) AS c FROM l1)
      SELECT (SELECT count(*) FROM l0) AS n, CASE WHEN c = 1 THEN (SELECT max(h) FROM l1) ELSE h END AS fingerprint FROM l2""",
    "q_incremental_embed_anti": f"""WITH {TICKETS}, h AS (SELECT pos, md5(etext) AS text_hash, etext FROM t)
      SELECT 'tf-idf' AS model, text_hash, length(min(etext)) AS chars FROM h
      WHERE text_hash NOT IN (SELECT text_hash FROM h JOIN labels ON doc_id = pos) GROUP BY 2""",
    "q_vector_norm_audit": f"""SELECT count(*) AS vectors, count(*) FILTER (abs(n - 1) > 1e-5) AS norm_violations, round_even(min(n), 6) AS min_norm,
      round_even(max(n), 6) AS max_norm FROM (SELECT sqrt({dot('embedding', 'embedding')}) AS n FROM embeddings)""",
    "q_topk_vectors": f"""WITH {SUMS}, ce2 AS (SELECT label AS pid, list_transform(total, lambda z: z / sqrt(list_dot_product(total, total))) AS c FROM su),
      r AS ({topk(f"SELECT pid, vec_id AS pos, round({dot('c', 'embedding')}, 9) AS s FROM ce2 CROSS JOIN embeddings", 5)})
      SELECT CAST(pid AS BIGINT) AS proposal_id, rank, CAST(pos AS VARCHAR) AS ticket_id, round(s, 6) AS similarity FROM r""",
    "q_tfidf_topk": f"WITH {EVIDENCE} SELECT pid AS proposal_id, rank, CAST(pos AS VARCHAR) AS ticket_id, round(s, 6) AS similarity FROM ev",
    "q_indexed_topk": f"WITH {EVIDENCE} SELECT pid AS proposal_id, rank, CAST(pos AS VARCHAR) AS ticket_id, round(s, 6) AS similarity FROM ev",
    "q_gate_counts": f"WITH {EVIDENCE} SELECT pid AS proposal_id, retrieved, validated, retrieved - validated AS rejected FROM gc",
    "q_similar_pairs_vectors": f"WITH {VECTOR_PAIRS} SELECT a, b, round(s, 6) AS similarity FROM vp WHERE s >= 0.35",
    "q_jaccard_pairs": f"WITH {PAIR_TEXTS} SELECT ticket_a, ticket_b, round(jaccard, 6) AS jaccard FROM {JACCARD}",
    "q_trigram_pairs": f"WITH {PAIR_TEXTS} SELECT ticket_a, ticket_b, round(trigram, 6) AS trigram FROM {TRIGRAM}",
    "q_components": f"WITH RECURSIVE {VECTOR_PAIRS}, ed AS (SELECT a, b FROM vp WHERE s >= 0.35), {reach('ed')} SELECT node, component FROM parts",
    "q_incremental_dedup": f"{SEMANTIC_MEMBERS} SELECT pos, component FROM mm",
    "q_semantic_dedup_stats": f"{SEMANTIC_MEMBERS} {stats()}",
    "q_semantic_dedup_groups": f"{SEMANTIC_MEMBERS} {GROUP_ROWS}",
    "q_cluster_medoid": f"""WITH {SUMS}, {SIZES}, m AS (SELECT label, vec_id, n, round({dot('embedding', 'total')} / n, 9) AS c FROM embeddings JOIN su USING (label) JOIN sz USING (label))
      SELECT CAST(label AS BIGINT) AS label, n AS size, vec_id AS representative_id, round(c, 6) AS centrality
      FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY c DESC, vec_id) AS rn FROM m) WHERE rn = 1""",
    "q_cluster_cohesion": f"""WITH {VECTOR_PAIRS} SELECT CAST(x.label AS BIGINT) AS label, any_value(n) AS size, round(avg({dot('x.embedding', 'y.embedding')}), 6) AS cohesion
      FROM vp JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b AND x.label = y.label JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) z ON z.label = x.label GROUP BY 1""",
    "q_cluster_stats": f"WITH {SIZES} SELECT count(*) AS total_clusters, round_even(avg(n), 2) AS average_cluster_size, max(n) AS largest, min(n) AS smallest FROM sz",
    "q_silhouette": f"""WITH {SIZES}, {VECTOR_PAIRS}, bo AS (SELECT a, b, s FROM vp UNION ALL SELECT b, a, s FROM vp),
      md AS (SELECT a, x.label AS own, y.label AS other, sum(1 - s) AS d FROM bo JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b GROUP BY 1, 2, 3),
      sa AS (SELECT a, max(d / (n - 1)) FILTER (own = other) AS i, min(d / n) FILTER (own <> other) AS o FROM md JOIN sz ON sz.label = other GROUP BY 1),
      co AS (SELECT x.label, avg(s) AS c FROM vp JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b AND x.label = y.label GROUP BY 1)
      SELECT round_even(avg((o - i) / greatest(o, i)), 4) AS silhouette_score, (SELECT round_even(avg(c), 4) FROM co) AS intra_cluster_coherence,
      (SELECT count(*) FROM sz) AS total_clusters FROM sa""",
    "q_evidence_factors": f"""WITH {EVIDENCE}, kept AS (SELECT pid, pos, s FROM ev WHERE s >= 0.3), {factors('kept')}
      SELECT pid AS proposal_id, n, round(m, 6) AS mean_similarity, round(ticket_volume, 6) AS ticket_volume, round(severity, 6) AS severity,
      round(sentiment_consistency, 6) AS sentiment_consistency, round(recency, 6) AS recency, round(diversity, 6) AS diversity FROM ft""",
    "q_evidence_score": f"""WITH {EVIDENCE}, kept AS (SELECT pid, pos, s FROM ev WHERE s >= 0.3), {factors('kept')}
      SELECT pid AS proposal_id, score, confidence, validated AS validated_tickets, retrieved AS retrieved_tickets, retrieved - validated AS rejected_tickets,
      average_similarity, sample_size, ticket_volume, severity, sentiment_consistency, recency, diversity FROM sd""",
    "q_evidence_prompt": f"""WITH {EVIDENCE}, kept AS (SELECT pid, pos, s FROM ev WHERE s >= 0.3), {factors('kept')},
      tb AS (SELECT pid, string_agg('Ticket ID: ' || ticket_id || chr(10) || 'Topic: ' || topic || chr(10) || 'Message: ' || message || chr(10) || '---', chr(10) ORDER BY rank) AS tk
        FROM ev JOIN t USING (pos) WHERE s >= 0.3 GROUP BY 1),
      pr AS (SELECT sd.pid AS proposal_id, {EVIDENCE_PROMPT} AS prompt FROM sd JOIN benchmark ON item_id = sd.pid LEFT JOIN tb ON tb.pid = sd.pid)
      SELECT proposal_id, md5(prompt) AS prompt_md5, length(prompt) AS chars FROM pr""",
    "q_decision": f"""{DOC_DECISIONS} SELECT pid AS proposal_id, recommendation, pri AS priority_score, decision_tier,
      round(round_even(gains, 2), 6) AS raw_benefits, round(round_even(drags, 2), 6) AS raw_frictions FROM dc""",
    "q_decision_tiers": f"{DOC_DECISIONS} SELECT recommendation, decision_tier, count(*) AS proposals FROM dc GROUP BY 1, 2",
    "q_decision_arrays": f"""{DOC_DECISIONS} SELECT pid AS proposal_id, {RATIONALE} AS rationale, {ASSUMPTIONS} AS assumptions, {RISKS} AS risks,
      {TRADES} AS trade_offs, {MISSING} AS missing_information FROM dc""",
    "q_decision_pipeline": f"""{DECISION_RUN} SELECT dc.pid AS proposal_id, recommendation, pri AS priority_score, decision_tier, ev AS evidence_score,
      {RISKS} AS risks, {MISSING} AS missing_information, total_input_count, unique_count, exact_duplicates_count, semantic_duplicates_count
      FROM dc JOIN ds ON ds.pid = dc.pid""".replace("(dup ", "(dc.dup "),
    "q_scenario_decisions": f"""{DECISION_RUN} SELECT dc.pid AS proposal_id, recommendation, pri AS priority_score, decision_tier, ev AS evidence_score,
      total_input_count, unique_count FROM dc JOIN ds ON ds.pid = dc.pid""".replace("(dup ", "(dc.dup ").replace(
        "FROM qv JOIN dv USING (f) GROUP BY", "FROM qv JOIN dv USING (f) JOIN documents own ON own.doc_id = dv.pos AND own.lang = ['en', 'fr', 'de', 'es'][qv.pid % 4 + 1] GROUP BY"),
    "q_truth_hits": f"""WITH {EVIDENCE}, g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
      h AS (SELECT pid, rank, pos, doc_id IS NOT NULL AS hit FROM ev LEFT JOIN g ON doc_id = pos)
      SELECT pid AS query_id, rank, CAST(pos AS VARCHAR) AS ticket_id, hit, CAST(count(*) FILTER (hit) OVER (PARTITION BY pid) AS BIGINT) AS total_relevant FROM h""",
    "q_calib_latest_outcome": f"WITH {RECORDS} SELECT record_id, actual_outcome FROM lo",
    "q_calib_summary": f"WITH {CALIB} SELECT * FROM cs",
    "q_calib_report": f"""WITH {CALIB} SELECT status, 'Historical Calibration Report (N=' || evaluated_records || '):' || chr(10) || '- Brier Score: ' || {fixed('brier_score', 4)}
      || ' (Optimal: 0.0)' || chr(10) || '- Expected Calibration Error (ECE): ' || {fixed('expected_calibration_error', 4)} || chr(10) || '- Calibration Tendency: '
      || CASE WHEN abs(calibration_bias) < 0.05 THEN 'Well-calibrated' WHEN calibration_bias > 0 THEN 'Overconfident' ELSE 'Underconfident' END
      || ' (Bias: ' || printf('%+.4f', calibration_bias) || ')' || chr(10) || '- Overall Accuracy: ' || {fixed('overall_accuracy * 100', 1)} || '%' || chr(10)
      || '- Status: ' || status AS summary_text FROM cs""",
    "q_calib_bins": f"""WITH {RECORDS}, {BINS} SELECT i AS bin_index, {fixed('lo', 2)} || ' - ' || {fixed('hi', 2)} AS bin_range, n AS count,
      coalesce(round_even(p, 3), 0.0) AS avg_confidence, coalesce(round_even(y, 3), 0.0) AS empirical_accuracy,
      coalesce(round_even(abs(y - p), 3), 0.0) AS calibration_gap FROM bt""",
    "q_calib_tiers": f"""WITH {RECORDS} SELECT z.tier, count(y) AS count, coalesce(round_even(avg(score), 1), 0.0) AS avg_score,
      coalesce(round_even(avg(y), 3), 0.0) AS empirical_success_rate, coalesce(round_even(avg(CAST((p >= 0.5) = (y >= 0.5) AS INT)), 3), 0.0) AS accuracy
      FROM (VALUES ('Low'), ('Moderate'), ('High')) z(tier) LEFT JOIN re ON re.tier = z.tier AND y IS NOT NULL GROUP BY 1""",
    "q_prediction_log": """WITH b AS (SELECT d.doc_id, l.doc_id IS NOT NULL AS labelled, toxic, quality, n_chars % 101 AS score, source, lang FROM documents d LEFT JOIN labels l USING (doc_id)),
      e AS (SELECT doc_id, unnest(CASE WHEN NOT labelled THEN ['lang=' || lang, 'source=' || source]
        WHEN toxic = 1 THEN ['clean=false', 'from=outcome', 'quality=' || quality] ELSE ['clean=' || (toxic = 0), 'from=label'] END) AS x FROM b),
      m AS (SELECT doc_id, coalesce(string_agg(x, ';' ORDER BY x), '') AS metadata FROM e GROUP BY 1)
      SELECT CAST(doc_id AS VARCHAR) AS record_id, CASE WHEN NOT labelled THEN 'document ' || doc_id END AS proposal,
        CASE WHEN labelled THEN quality * 60.0::DOUBLE + 20.0 ELSE CAST(score AS DOUBLE) END AS predicted_score,
        CASE WHEN labelled THEN NULL WHEN score < 40 THEN 'Low' WHEN score < 70 THEN 'Moderate' ELSE 'High' END AS predicted_confidence,
        CASE WHEN toxic = 1 THEN 0.25::DOUBLE ELSE CAST(quality AS DOUBLE) END AS actual_outcome, metadata FROM b JOIN m USING (doc_id)""",
    "q_store_growth": """WITH t AS (SELECT 1 AS batch, text FROM benchmark UNION ALL SELECT 2, text FROM conversations UNION ALL SELECT 3, text FROM documents),
      f AS (SELECT batch, count(*) AS embedded FROM (SELECT text, min(batch) AS batch FROM t WHERE text IS NOT NULL GROUP BY 1) GROUP BY 1),
      r AS (SELECT batch, count(*) AS rows, count(text) AS with_vector FROM t GROUP BY 1)
      SELECT CAST(batch AS BIGINT) AS batch, coalesce(embedded, 0) AS embedded, CAST(sum(coalesce(embedded, 0)) OVER (ORDER BY batch) AS BIGINT) AS stored, rows, with_vector
      FROM r LEFT JOIN f USING (batch)""",
    "q_ir_metrics": f"""WITH {SIZES}, {VE}, {ranked(5)} SELECT query_id, retrieved_count, relevant_in_top_k, total_relevant, round(precision_at_k, 6) AS precision_at_k,
      round(recall_at_k, 6) AS recall_at_k, round(reciprocal_rank, 6) AS reciprocal_rank, round(average_precision, 6) AS average_precision FROM ir""",
    "q_ir_macro": f"WITH {SIZES}, {VE}, {ranked(5)} SELECT {MACRO} FROM ir",
    "q_negative_controls": f"""WITH {TFIDF}, tu AS (SELECT conv_id || '-' || turn AS pid, text FROM conversations), {queries_cte('tu')},
      bf AS (SELECT item_id AS pos, {hexnum('w', 8)} % 262144 AS f, count(*) AS c FROM (SELECT item_id, unnest({words('text')}) AS w FROM benchmark) GROUP BY 1, 2),
      bw AS (SELECT pos, f, c * (1 + ln((1.0 + n) / (1.0 + coalesce(d, 0)))) AS w FROM bf LEFT JOIN df USING (f) CROSS JOIN nd),
      bv AS (SELECT pos, f, w / l AS w FROM bw JOIN (SELECT pos, sqrt(sum(w * w)) AS l FROM bw GROUP BY 1) USING (pos)),
      r AS ({topk('SELECT pid, pos, round(sum(qv.w * bv.w), 9) AS s FROM qv JOIN bv USING (f) GROUP BY 1, 2', 5)})
      SELECT tu.pid AS query_id, coalesce(round_even(max(s), 4), 0.0) AS top_similarity_score, count(*) FILTER (s >= 0.3) AS false_positives_above_evidence_threshold,
      count(*) FILTER (s >= 0.3) = 0 AS properly_rejected FROM tu LEFT JOIN r ON r.pid = tu.pid GROUP BY 1""",
    "q_dedup_confusion": f"""{SEMANTIC_MEMBERS}, {ANNOTATED}, {JUDGED}, cm AS ({confusion()}), {RATES} SELECT {COUNTS}, tp + fp + fn + tn AS total_annotated_pairs,
      round_even(p, 4) AS precision, round_even(r, 4) AS recall, round_even(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 1.0 END, 4) AS specificity,
      {F1}, round_even((tp + tn) / (tp + fp + fn + tn), 4) AS accuracy FROM precision_""",
    "q_dedup_pair_eval": f"""{SEMANTIC_MEMBERS}, {ANNOTATED}, de AS (SELECT DISTINCT least(rep, ticket_id) AS a, greatest(rep, ticket_id) AS b FROM r WHERE rn > 1),
      tr AS (SELECT DISTINCT least(ticket_a, ticket_b) AS a, greatest(ticket_a, ticket_b) AS b FROM ap WHERE is_duplicate),
      cm AS (SELECT (SELECT count(*) FROM de JOIN tr USING (a, b)) AS tp, (SELECT count(*) FROM de ANTI JOIN tr USING (a, b)) AS fp,
        (SELECT count(*) FROM tr ANTI JOIN de USING (a, b)) AS fn), {RATES}
      SELECT round_even(p, 4) AS precision, round_even(r, 4) AS recall, {F1}, tp AS true_positives, fp AS false_positives, fn AS false_negatives,
      tp + fp AS detected_pairs_count, tp + fn AS ground_truth_pairs_count FROM precision_""",
    "q_error_causes": f"""{SEMANTIC_MEMBERS}, {PAIR_TEXTS}, {JUDGED}, {PAIR_COSINE},
      er AS (SELECT ticket_a, ticket_b, predicted, cosine AS s, length({strip('ma')}) < 30 OR length({strip('mb')}) < 30 AS short,
        len(list_filter(list_intersect(regexp_split_to_array(lower({strip('ma')}), '{K.WS}+'), regexp_split_to_array(lower({strip('mb')}), '{K.WS}+')),
          lambda z: NOT list_contains([{', '.join(q(w) for w in K.GENERIC_WORDS)}], z))) AS telling
        FROM judged JOIN pt USING (ticket_a, ticket_b) JOIN pc USING (ticket_a, ticket_b) WHERE judged.is_duplicate <> predicted)
      SELECT ticket_a, ticket_b, CASE WHEN predicted THEN 'FALSE_POSITIVE' ELSE 'FALSE_NEGATIVE' END AS error_type,
      CASE WHEN predicted THEN CASE WHEN s >= 0.85 AND s < 0.85::DOUBLE + 0.05::DOUBLE THEN 'threshold_too_low' WHEN short THEN 'short_message'
          WHEN telling <= 1 THEN 'embedding_confusion' ELSE 'different_intent' END
        ELSE CASE WHEN s < 0.85 AND s >= 0.85::DOUBLE - 0.10::DOUBLE THEN 'threshold_too_high' WHEN short THEN 'short_message' ELSE 'embedding_confusion' END END AS classified_cause,
      round(s, 4) AS similarity FROM er""",
    "q_candidate_filters": f"""WITH {TFIDF}, {PAIR_TEXTS}, {PAIR_COSINE}, cf(candidate_name, c, j, g, topic) AS (VALUES
      {', '.join(f"({q(n)}, {c}, {j}, {g}, {str(t).upper()})" for n, c, j, g, t in K.CANDIDATE_FILTERS)}),
      judged AS (SELECT candidate_name, is_duplicate, cosine >= c AND (j = 0 OR jaccard >= j) AND (g = 0 OR trigram >= g)
        AND (NOT topic OR lower({strip('ta')}) = lower({strip('tb')})) AS predicted
        FROM pt JOIN pc USING (ticket_a, ticket_b) JOIN {JACCARD} USING (ticket_a, ticket_b) JOIN {TRIGRAM} USING (ticket_a, ticket_b) CROSS JOIN cf),
      cm AS ({confusion('candidate_name')}), {RATES} SELECT candidate_name, {COUNTS}, round_even(p, 4) AS precision, round_even(r, 4) AS recall, {F1} FROM precision_""",
    "q_gate_sweep": f"""WITH {SIZES}, {VE}, {ranked(10)}, th AS (SELECT unnest([{', '.join(f'{g}::DOUBLE' for g in GATES)}]) AS threshold),
      gq AS (SELECT vec_id, threshold, any_value(n) - 1 AS rel, count(rank) AS found, count(*) FILTER (s >= threshold) AS kept, count(*) FILTER (s >= threshold AND hit) AS tp
        FROM ve JOIN sz USING (label) CROSS JOIN th LEFT JOIN rk ON q = vec_id WHERE n > 1 GROUP BY 1, 2),
      gr AS (SELECT *, CASE WHEN kept > 0 THEN tp / kept ELSE 1.0 END AS p, CASE WHEN rel > 0 THEN tp / rel ELSE 0.0 END AS r FROM gq)
      SELECT threshold, round_even(avg(p), 4) AS precision, round_even(avg(r), 4) AS recall, round_even(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END), 4) AS f1_score,
      round_even(avg(CASE WHEN found > 0 THEN kept / found ELSE 0.0 END), 4) AS average_retention_rate, count(*) AS queries_evaluated FROM gr GROUP BY 1""",
    "q_dedup_sweep": f"""WITH RECURSIVE {TFIDF}, k AS (SELECT *, {key('topic')} || '||' || {key('message')} AS k FROM t),
      c AS (SELECT *, min(pos) OVER (PARTITION BY k) AS component FROM k), {semantic(0.70)}, th AS (SELECT unnest([{', '.join(f'{g}::DOUBLE' for g in K.DEDUP_SWEEP)}]) AS threshold),
      ed AS (SELECT threshold, a, b FROM ({EXACT_EDGES}) CROSS JOIN th UNION SELECT threshold, a, b FROM sp CROSS JOIN th WHERE s >= threshold), {reach('ed', group='threshold')},
      mm AS (SELECT k.*, th.threshold, coalesce(component, pos) AS component FROM k CROSS JOIN th LEFT JOIN parts ON node = pos AND parts.threshold = th.threshold),
      m AS (SELECT *, row_number() OVER (PARTITION BY threshold, component ORDER BY length(message) DESC, pos) AS rn FROM mm), {ANNOTATED},
      judged AS (SELECT th.threshold, is_duplicate, coalesce(x.component = y.component, FALSE) AND (x.rn = 1 OR y.rn = 1) AS predicted FROM ap CROSS JOIN th
        LEFT JOIN m x ON x.ticket_id = ticket_a AND x.threshold = th.threshold LEFT JOIN m y ON y.ticket_id = ticket_b AND y.threshold = th.threshold),
      cm AS ({confusion('threshold')}), {RATES} SELECT threshold, round_even(p, 4) AS precision, round_even(r, 4) AS recall, {F1}, {COUNTS} FROM precision_""",
    "q_bootstrap_ci": f"""WITH v AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS i, length(text) / 100.0 AS value FROM benchmark), n AS (SELECT count(*) AS n FROM v),
      dr AS (SELECT r, {hexnum("'42:' || r || ':' || s", 15)} % n AS i FROM n, range(1000) a(r), LATERAL (SELECT unnest(range(n)) AS s)),
      me AS (SELECT r, avg(value) AS m FROM dr JOIN v USING (i) GROUP BY 1)
      SELECT (SELECT n FROM n) AS n, round_even(quantile_cont(m, 0.025), 4) AS ci_lower, round_even(quantile_cont(m, 0.975), 4) AS ci_upper FROM me""",
}

ORACLE = {name: exact_rounding(sql) for name, sql in ORACLE.items()}
