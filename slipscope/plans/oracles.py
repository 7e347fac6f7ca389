"""SQL snippets of the oracles: scalar rules as DuckDB expressions."""

from __future__ import annotations

from ..functions import lexicon
from . import inputs


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(xs: list[str]) -> str:
    return "[" + ", ".join(map(quoted, xs)) + "]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def blank_words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w_: w_ <> '')"


def letters(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}_]+'), lambda w_: w_ <> '')"


def sentences(x: str) -> str:
    marked = rf"regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(regexp_split_to_array({marked}, '[' || chr(1) || chr(10) || ']'), lambda s_: {strip('s_')}), lambda s_: s_ <> '')"


def markers(words: str, low: str, ms: list[str]) -> str:
    singles, phrases = [m for m in ms if " " not in m], [m for m in ms if " " in m]
    parts = [f"len(list_filter({words}, lambda m_: list_contains({listed(singles)}, m_)))"]
    parts += [f"(length({low}) - length(replace({low}, {quoted(p)}, ''))) // {len(p)}" for p in phrases]
    return "CAST(" + " + ".join(parts) + " AS BIGINT)"


def clean(x: str) -> str:
    for p in lexicon.CUTS:
        x = f"list_transform([{x}], lambda t_: CASE WHEN instr(t_, {quoted(p)}) > 1 THEN substr(t_, 1, instr(t_, {quoted(p)}) - 1) ELSE t_ END)[1]"
    return strip(x)


def normalise(x: str) -> str:
    out = strip(f"lower({x})")
    for _ in range(2):  # RE2 has no look-around: neighbouring articles need a second pass
        out = rf"regexp_replace({out}, '(^|[^\p{{L}}\p{{N}}_])(a|an|the)([^\p{{L}}\p{{N}}_]|$)', '\1 \3', 'g')"
    out = rf"regexp_replace({out}, '[^\p{{L}}\p{{N}}_\s]', '', 'g')"
    return strip(rf"regexp_replace({out}, '\s+', ' ', 'g')")


def numerical(x: str) -> str:
    said = rf"regexp_extract({x}, '[Tt]he answer is\s*[:\s]*\$?([0-9,]+(?:\.[0-9]+)?)', 1)"
    last = rf"coalesce(regexp_extract_all({x}, '-?[0-9,]+(?:\.[0-9]+)?')[-1], '')"
    return f"replace(CASE WHEN {said} <> '' THEN {said} ELSE {last} END, ',', '')"


def letter(x: str) -> str:
    t = f"upper({strip(x)})"
    marked = rf"regexp_extract({t}, '\(?([A-D])\)?[.\s:,)]', 1)"
    return rf"CASE WHEN {t} IN ('A', 'B', 'C', 'D') THEN {t} WHEN {marked} <> '' THEN {marked} WHEN substr({t}, 1, 1) IN ('A', 'B', 'C', 'D') AND regexp_matches({t}, '^.[^\p{{L}}]') THEN substr({t}, 1, 1) ELSE '' END"


#: Factual answers of table j: CTEs up to "fa" (task_id, answer).
def factual_ctes(source: str) -> str:
    tail = f"rtrim({strip('ltrim(substr(l_, instr(lower(l_), c_) + length(c_)), ' + quoted(':,; ') + ')')}, '.!,;:')"
    out = f"""
f0 AS (SELECT task_id, list_filter(list_transform(string_split({strip('response')}, chr(10)), lambda s_: {strip('s_')}), lambda s_: s_ <> '') AS lines FROM {source}),
f1 AS (SELECT task_id, lines, list_filter(flatten(list_transform(lines, lambda l_: list_transform({listed(lexicon.CUES)}, lambda c_: CASE WHEN contains(lower(l_), c_) THEN {tail} END))), lambda f_: f_ IS NOT NULL AND f_ <> '') AS found FROM f0),
g0 AS (SELECT task_id, coalesce(found[1], lines[1], '') AS x FROM f1)"""
    for i, o in enumerate(lexicon.OPENINGS):
        out += f",\ng{i + 1} AS (SELECT task_id, CASE WHEN starts_with(lower(x), {quoted(o)}) THEN {strip(f'substr(x, {len(o) + 1})')} ELSE x END AS x FROM g{i})"
    out += f""",
h0 AS (SELECT task_id, rtrim(x, '.!,;:') AS x FROM g{len(lexicon.OPENINGS)}),
h1 AS (SELECT task_id, x, CASE WHEN x ILIKE '% is %' THEN ' is ' WHEN x ILIKE '% was %' THEN ' was ' WHEN x ILIKE '% are %' THEN ' are ' WHEN x ILIKE '% were %' THEN ' were ' END AS s FROM h0),
h2 AS (SELECT task_id, x, s, rtrim({strip("regexp_extract(x, '(?is)^.*?' || s || '(.*)$', 1)")}, '.') AS t FROM h1),
fa AS (SELECT task_id, {strip(f"CASE WHEN s IS NOT NULL AND len({blank_words('x')}) > 6 AND len({blank_words('t')}) BETWEEN 1 AND len({blank_words('x')}) - 2 THEN t ELSE x END")} AS answer FROM h2)"""
    return out


#: Judged answers: CTEs up to "judged" (task_id, domain, extracted_answer, is_correct, and the inputs).
def judged_ctes() -> str:
    number = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"
    near = "(len(aw) <= 5 AND length(c) > 2 AND (contains(a, c) OR contains(c, a)))"
    ends = "(len(cw) <= 3 AND len(aw) > len(cw) AND aw[len(aw) - len(cw) + 1 : len(aw)] = cw)"
    return f"""j AS (SELECT * FROM {inputs.sql(inputs.ANSWERS)}),{factual_ctes('j')},
ex AS (SELECT j.*, CASE domain WHEN 'reasoning' THEN {numerical('response')} WHEN 'commonsense' THEN {letter('response')} ELSE fa.answer END AS extracted_answer FROM j JOIN fa USING (task_id)),
mc AS (SELECT task_id, {normalise('extracted_answer')} AS a, unnest([{normalise('ground_truth')}, {normalise('alias')}]) AS c FROM ex),
mt AS (SELECT task_id, bool_or(c <> '' AND (a = c OR {near} OR {ends} OR (len(cw) = 1 AND list_contains(aw, c)))) AS met FROM (SELECT *, {blank_words('a')} AS aw, {blank_words('c')} AS cw FROM mc) GROUP BY task_id),
judged AS (SELECT ex.*, CASE domain
  WHEN 'reasoning' THEN coalesce(CASE WHEN regexp_matches(extracted_answer, {number}) THEN TRY_CAST({strip('extracted_answer')} AS DOUBLE) END = CASE WHEN regexp_matches(replace(ground_truth, ',', ''), {number}) THEN TRY_CAST(replace(ground_truth, ',', '') AS DOUBLE) END, false)
  WHEN 'commonsense' THEN upper({strip('extracted_answer')}) = upper({strip('ground_truth')})
  ELSE mt.met END AS is_correct FROM ex JOIN mt USING (task_id))"""


#: Features of the responses: CTEs up to "features".
def features_ctes() -> str:
    evidence = lexicon.DIRECT_EVIDENCE + lexicon.INDIRECT_EVIDENCE
    singles, phrases = [m for m in evidence if " " not in m], [m for m in evidence if " " in m]
    bald = " AND ".join([f"NOT list_has_any({letters('s_')}, {listed(singles)})", *(f"NOT contains(lower(s_), {quoted(p)})" for p in phrases)])
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0.5::DOUBLE END"
    at = lambda i: f"coalesce(w_[{i}], '')"
    participle = lambda i: f"(regexp_matches({at(i)}, 'ed$') OR list_contains({listed(lexicon.PARTICIPLES)}, {at(i)}))"
    passive = f"len(list_filter(range(1, len(w_) + 1), lambda i_: list_contains({listed(lexicon.BE)}, w_[i_]) AND ({participle('i_ + 1')} OR (({at('i_ + 1')} = 'not' OR regexp_matches({at('i_ + 1')}, 'ly$')) AND {participle('i_ + 2')})))) > 0"
    count = lambda *ws: f"len(list_filter(words, lambda m_: list_contains({listed(list(ws))}, m_)))"
    return rf"""r AS (SELECT * FROM {inputs.sql(inputs.RESPONSES)}),
r1 AS (SELECT task_id, domain, lower(response) AS low, {letters('response')} AS words, {sentences('response')} AS sents FROM r),
r2 AS (SELECT *, list_transform(sents, lambda s_: {letters('s_')}) AS sw, CAST(len(sents) AS BIGINT) AS n_sentences,
  coalesce(CAST(list_sum(list_transform(sents, lambda s_: len(regexp_extract_all(s_, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')))) AS BIGINT), 0) AS n_tokens FROM r1),
r3 AS (SELECT task_id, domain, n_sentences,
  {markers('words', 'low', lexicon.BOOSTERS)} AS n_boosters, {markers('words', 'low', lexicon.HEDGES)} AS n_hedges,
  {markers('words', 'low', lexicon.DIRECT_EVIDENCE)} AS n_direct_evidence, {markers('words', 'low', lexicon.INDIRECT_EVIDENCE)} AS n_indirect_evidence,
  CAST(len(list_filter(sents, lambda s_: {bald})) AS BIGINT) AS n_bald_assertions,
  coalesce({markers('sw[1]', 'lower(sents[1])', lexicon.HEDGES)} = 0, false) AS claim_in_first_sentence,
  {markers('words', 'low', lexicon.CONCESSIVES)} AS n_concessive_structures,
  {ratio(count('the'), count('the', 'a', 'an'))} AS definite_reference_ratio,
  {ratio("len(list_filter(sents, lambda s_: NOT suffix(s_, '?')))", 'n_sentences')} AS declarative_ratio,
  {ratio(f'len(list_filter(sw, lambda w_: NOT {passive}))', 'n_sentences')} AS active_voice_ratio,
  CASE WHEN n_sentences > 0 THEN CAST(n_tokens AS DOUBLE) / n_sentences ELSE 0 END AS mean_sentence_length,
  list_transform([flatten(sw)], lambda w_: len(w_) >= 4 AND len(list_distinct(list_transform(range(1, len(w_) - 1), lambda i_: w_[i_] || ' ' || w_[i_ + 1] || ' ' || w_[i_ + 2]))) < len(w_) - 2)[1] AS has_repetition
  FROM r2),
r4 AS (SELECT *, {ratio('n_boosters', '(n_boosters + n_hedges)')} AS booster_ratio FROM r3),
features AS (SELECT *, (2.0::DOUBLE * booster_ratio + 0.5::DOUBLE * {ratio('n_bald_assertions', 'n_sentences')} + CASE WHEN claim_in_first_sentence THEN 1 ELSE 0 END
  + (1 - least(n_concessive_structures / 3.0::DOUBLE, 1)) + definite_reference_ratio + 1.5::DOUBLE * declarative_ratio + 1.5::DOUBLE * active_voice_ratio
  + least(mean_sentence_length / 30, 1) + CASE WHEN has_repetition THEN 0 ELSE 0.5::DOUBLE END) / 10 AS lcs_score FROM r4)"""


#: Scores of the composite: CTEs up to "scored" (all rows with both scores) and "ranked" (errors, min-max).
def scored_ctes() -> str:
    scale = lambda c: f"CASE WHEN max({c}) OVER () - min({c}) OVER () < 1e-8 THEN 0.5::DOUBLE ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"
    return f"""isd AS (SELECT * FROM {inputs.sql(inputs.ISD)}), lcs AS (SELECT * FROM {inputs.sql(inputs.LCS)}),
scored AS (SELECT isd.*, lcs.lcs_score FROM isd JOIN lcs USING (task_id)),
errors AS (SELECT * FROM scored WHERE NOT is_correct),
scaled AS (SELECT task_id, domain, is_correct, {scale('isd_score')} AS isd_score, {scale('lcs_score')} AS lcs_score FROM errors),
ranked AS (SELECT *, 0.5::DOUBLE * isd_score + 0.5::DOUBLE * lcs_score AS pei_score, isd_score * lcs_score AS pei_multiplicative,
  row_number() OVER (ORDER BY 0.5::DOUBLE * isd_score + 0.5::DOUBLE * lcs_score DESC, task_id) AS pei_rank FROM scaled)"""


def average_rank(value: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    same = f"{by}, {value}" if by else value
    return f"(rank() OVER ({part}ORDER BY {value}) + (count(*) OVER (PARTITION BY {same}) - 1) / 2.0::DOUBLE)"


#: Steps of the fits below: gradient descent with momentum for probes, Newton's method for sigmoids.
DESCENT, NEWTON = 400, 30


def split_ctes(name: str, source: str, seed: int, share: float) -> str:
    """``name``: rows of source (task_id, y) with ``held``, by largest remainders and a hash of seed and id."""
    return f"""{name}_n AS (SELECT y, count(*) AS n, count(*) * {share}::DOUBLE AS x FROM {source} GROUP BY y),
{name}_q AS (SELECT y, floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, y) <= ceil(round(sum(n) OVER () * {share}::DOUBLE, 9)) - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS take FROM {name}_n),
{name} AS (SELECT task_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('{seed}-' || task_id), task_id) <= take AS held FROM {source} JOIN {name}_q USING (y))"""


def sigmoid_ctes(name: str, source: str) -> str:
    """``name`` (l, a, b): Platt's sigmoid for each l of source (l, margin, y), by Newton's method."""
    return f"""{name}_t AS (SELECT l, margin AS m, CASE WHEN y = 1 THEN (sum(y) OVER (PARTITION BY l) + 1.0::DOUBLE) / (sum(y) OVER (PARTITION BY l) + 2) ELSE 1.0::DOUBLE / (sum(1 - y) OVER (PARTITION BY l) + 2) END AS t FROM {source}),
{name}_s AS (SELECT DISTINCT l, 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM {name}_t UNION ALL
  SELECT l, i + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
    SELECT l, i, a, b, sum((p - t) * m) AS ga, sum(p - t) AS gb, sum(p * (1 - p) * m * m) AS haa, sum(p * (1 - p) * m) AS hab, sum(p * (1 - p)) AS hbb
    FROM (SELECT *, 1 / (1 + exp(-(a * m + b))) AS p FROM {name}_s JOIN {name}_t USING (l) WHERE i < {NEWTON}) GROUP BY l, i, a, b)),
{name} AS (SELECT l, a, b FROM {name}_s WHERE i = {NEWTON})"""


def probe_ctes(calibrated: bool) -> str:
    """CTEs up to "probes" (layer_idx, accuracy, auc, n_train, n_test) and "scores" (task_id, y, layer_idx, p), with slices of embeddings as layers."""
    inner = split_ctes("cal", "(SELECT task_id, y FROM outer_split WHERE NOT held)", 43, 0.15) if calibrated else "cal AS (SELECT task_id, y, false AS held FROM outer_split WHERE NOT held)"
    sums = ", ".join(f"sum(e * z[{i}])" for i in range(1, 14))
    shift = sigmoid_ctes("platt", "(SELECT l, margin, y FROM margins WHERE part = 'calibration')") if calibrated else "platt AS (SELECT DISTINCT l, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM margins)"
    return f"""emb AS (SELECT CAST(vec_id AS VARCHAR) AS task_id, CAST(label < 5 AS INT) AS y, embedding FROM embeddings),
{split_ctes("outer_split", "(SELECT task_id, y FROM emb)", 42, 0.2)},
{inner},
parts AS (SELECT o.task_id, CASE WHEN o.held THEN 'test' WHEN cal.held THEN 'calibration' ELSE 'fit' END AS part FROM outer_split o LEFT JOIN cal USING (task_id)),
flat AS (SELECT task_id, y, part, l, i, CAST(embedding[12 * l + i] AS DOUBLE) AS x FROM emb JOIN parts USING (task_id), unnest(range(0, 5)) AS u(l), unnest(range(1, 13)) AS v(i)),
scale AS (SELECT l, i, avg(x) AS m, stddev_pop(x) AS sd FROM flat WHERE part <> 'test' GROUP BY l, i),
vecs AS (SELECT l, task_id, y, part, list_append(list((x - m) / sd ORDER BY i), 1.0::DOUBLE) AS z FROM flat JOIN scale USING (l, i) GROUP BY l, task_id, y, part),
fits AS (SELECT DISTINCT l, 0 AS i, list_transform(range(0, 13), lambda k: 0.0::DOUBLE) AS w, list_transform(range(0, 13), lambda k: 0.0::DOUBLE) AS v FROM vecs UNION ALL
  SELECT l, i + 1, list_transform(range(1, 14), lambda k: w[k] - v2[k]), v2 FROM (
    SELECT l, i, w, list_transform(range(1, 14), lambda k: 0.8::DOUBLE * v[k] + 0.5::DOUBLE / n * (g[k] + CASE WHEN k < 13 THEN w[k] ELSE 0 END)) AS v2 FROM (
      SELECT l, i, w, v, count(*) AS n, [{sums}] AS g FROM (SELECT *, 1 / (1 + exp(-list_dot_product(w, z))) - y AS e FROM fits JOIN (SELECT * FROM vecs WHERE part = 'fit') USING (l) WHERE i < {DESCENT}) GROUP BY l, i, w, v))),
margins AS (SELECT l, task_id, y, part, list_dot_product(w, z) AS margin FROM vecs JOIN (SELECT l, w FROM fits WHERE i = {DESCENT}) USING (l)),
{shift},
tested AS (SELECT l, y, a * margin + b AS margin FROM margins JOIN platt USING (l) WHERE part = 'test'),
ranks AS (SELECT l, y, margin, {average_rank('margin', 'l')} AS r FROM tested),
scores AS (SELECT task_id, y, CAST(l AS INT) AS layer_idx, 1 / (1 + exp(-(a * margin + b))) AS p FROM margins JOIN platt USING (l)),
probes AS (SELECT CAST(l AS INT) AS layer_idx, round(avg(CASE WHEN (margin > 0) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy,
  round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * sum(1 - y)), 6) AS auc,
  (SELECT count(*) FROM parts WHERE part = 'fit') AS n_train, count(*) AS n_test FROM ranks GROUP BY l)"""
