"""The registered queries, one for each operator, and their SQL. All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, lexicon, markers, text
from ..operators import abbreviations, composite, judging, probes, ranks, reports, stats, surface
from ..sources import store, tasks
from . import inputs, oracles
from .run import generate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Inputs


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.read(spark, sf, inputs.ANSWERS)
    return rows.withColumn("metadata", F.struct(F.array("alias").alias("aliases")))


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.read(spark, sf, inputs.RESPONSES)


def _isd(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.read(spark, sf, inputs.ISD)


def _lcs(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.read(spark, sf, inputs.LCS)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return composite.joined(_isd(spark, sf), _lcs(spark, sf))


def _index(spark: SparkSession, sf: str) -> DataFrame:
    out = composite.index(_isd(spark, sf), _lcs(spark, sf))
    return out.withColumn("pei_multiplicative", composite.multiplicative(F.col("isd_score"), F.col("lcs_score")))


def _activations(spark: SparkSession, sf: str) -> DataFrame:
    """Slices of embeddings as the hidden states of five layers."""
    rows = inputs.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("task_id"), (F.col("label") < 5).cast("double").alias("label"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("layer_idx"), "embedding")
    return rows.select("task_id", "label", "layer_idx", F.slice("embedding", F.col("layer_idx") * 12 + 1, F.lit(12)).alias("act"))


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("task_id"), (F.col("label") < 5).cast("double").alias("label"))


WITH_SCORED = "WITH " + oracles.scored_ctes()
WITH_JUDGED = "WITH " + oracles.judged_ctes()
WITH_FEATURES = "WITH " + oracles.features_ctes()

# Sources and sinks

_DRAW = "row_number() OVER (ORDER BY md5(concat('42-', CAST({key} AS VARCHAR))), {key}) - 1"
_WORDS = "string_split(text, ' ')"


def _qa_source(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split("text", " ")
    return inputs.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"), F.struct(words[0].alias("value"), F.slice(words, 2, 2).alias("aliases")).alias("answer"))


def _maths_source(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("question"), F.concat("text", F.lit(" #### 0 ####  "), F.col("n_chars").cast("string"), F.lit(" \n")).alias("answer"))


def _choice_source(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("ctx"), F.slice(F.split("text", " "), 1, 4).alias("endings"), (F.col("item_id") % 4).cast("string").alias("label"))


_QA_SQL = f"SELECT printf('tqa_%04d', {_DRAW.format(key='item_id')}) AS task_id, 'factual_qa' AS domain, 'Answer the following question concisely.' || chr(10) || chr(10) || 'Question: ' || text || chr(10) || 'Answer:' AS prompt, {_WORDS}[1] AS ground_truth, array_to_string({_WORDS}[2:3], '|') AS detail FROM benchmark"
_MATHS_SQL = f"SELECT printf('gsm_%04d', {_DRAW.format(key='doc_id')}) AS task_id, 'reasoning' AS domain, 'Solve the following maths problem. Show your working, then give the final numerical answer after ''The answer is''.' || chr(10) || chr(10) || 'Problem: ' || text || chr(10) || 'Solution:' AS prompt, CAST(n_chars AS VARCHAR) AS ground_truth, text || ' #### 0 ####  ' || CAST(n_chars AS VARCHAR) || ' ' || chr(10) AS detail FROM documents"
_CHOICE_SQL = f"SELECT printf('hs_%04d', {_DRAW.format(key='item_id')}) AS task_id, 'commonsense' AS domain, 'Choose the most plausible continuation.' || chr(10) || chr(10) || 'Context: ' || text || chr(10) || chr(10) || 'Options:' || chr(10) || array_to_string(list_transform(range(1, len({_WORDS}[1:4]) + 1), lambda i: '  (' || chr(CAST(64 + i AS INT)) || ') ' || {_WORDS}[i]), chr(10)) || chr(10) || chr(10) || 'Answer with the letter only (A, B, C, or D):' AS prompt, chr(CAST(65 + item_id % 4 AS INT)) AS ground_truth, {_WORDS}[CAST(item_id % 4 AS INT) + 1] AS detail FROM benchmark"


@query(_QA_SQL)
def io1_load_questions(spark: SparkSession, sf: str) -> DataFrame:
    rows = tasks.question_answering(_qa_source(spark, sf), 2**31 - 1)
    return rows.select("task_id", "domain", "prompt", "ground_truth", F.array_join("metadata.aliases", "|").alias("detail"))


@query(_MATHS_SQL)
def io2_load_maths(spark: SparkSession, sf: str) -> DataFrame:
    rows = tasks.maths(_maths_source(spark, sf), 2**31 - 1)
    return rows.select("task_id", "domain", "prompt", "ground_truth", F.col("metadata.full_solution").alias("detail"))


@query(_CHOICE_SQL)
def io3_load_choices(spark: SparkSession, sf: str) -> DataFrame:
    rows = tasks.multiple_choice(_choice_source(spark, sf), 2**31 - 1)
    return rows.select("task_id", "domain", "prompt", "ground_truth", F.col("metadata.correct_ending").alias("detail"))


@query(f"SELECT task_id, domain, ground_truth FROM ({_QA_SQL}) UNION ALL SELECT task_id, domain, ground_truth FROM ({_MATHS_SQL}) UNION ALL SELECT task_id, domain, ground_truth FROM ({_CHOICE_SQL})")
def io4_all_loaders(spark: SparkSession, sf: str) -> DataFrame:
    sources = {"factual_qa": _qa_source(spark, sf), "reasoning": _maths_source(spark, sf), "commonsense": _choice_source(spark, sf)}
    return tasks.load_tasks(sources, {d: 2**31 - 1 for d in ("factual_qa", "reasoning", "commonsense", "unknown")}).select("task_id", "domain", "ground_truth")


def _round_trip(df: DataFrame, schema: str, order: str | None = None) -> DataFrame:
    path = store.new_path(df.sparkSession, "jsonl")
    store.write_jsonl(df, path, order)
    return store.read_jsonl(df.sparkSession, path, schema)


@query(f"SELECT task_id, domain, prompt, ground_truth, response FROM {inputs.sql(inputs.ANSWERS)}")
def io5_responses_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    rows = _answers(spark, sf).select("task_id", "domain", "prompt", "ground_truth", "metadata", "response")
    return _round_trip(rows, store.RESPONSES).select("task_id", "domain", "prompt", "ground_truth", "response")


@query(f"{WITH_JUDGED} SELECT task_id, domain, is_correct, extracted_answer FROM judged")
def io6_judged_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    return _round_trip(judging.judge(_answers(spark, sf)).drop("alias"), store.JUDGED).select("task_id", "domain", "is_correct", "extracted_answer")


@query(f"{WITH_FEATURES} SELECT task_id, round(lcs_score, 6) AS lcs_score, n_sentences FROM features")
def io7_features_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_round_trip(surface.features(_responses(spark, sf)), store.FEATURES).select("task_id", "lcs_score", "n_sentences"), "lcs_score")


@query(f"WITH isd AS (SELECT * FROM {inputs.sql(inputs.ISD)}) SELECT task_id, round(isd_score, 6) AS at_seven, CAST(2 AS INT) AS layers FROM isd")
def io8_isd_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    rows = _isd(spark, sf).withColumn("layer_scores", F.create_map(F.lit(0), F.lit(0.5), F.lit(7), F.col("isd_score")))
    back = _round_trip(rows, store.ISD)
    return back.select("task_id", F.round(F.col("layer_scores")[7], 6).alias("at_seven"), F.size("layer_scores").alias("layers"))


@query(f"{WITH_SCORED} SELECT task_id, pei_rank FROM ranked")
def io9_index_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    return _round_trip(_index(spark, sf).drop("pei_multiplicative"), store.SCORED, order="pei_rank").select("task_id", "pei_rank")


@query("SELECT CAST(vec_id AS VARCHAR) AS task_id, CAST(l AS INT) AS layer_idx, round(CAST(embedding[12 * l + 1] AS DOUBLE), 6) AS first FROM embeddings, unnest(range(0, 5)) AS u(l)")
def io10_activations(spark: SparkSession, sf: str) -> DataFrame:
    path = store.new_path(spark, "activations")
    store.write_activations(_activations(spark, sf), path)
    return store.read_activations(spark, path).select("task_id", "layer_idx", F.round(F.col("act")[0].cast("double"), 6).alias("first"))


@query(f"WITH RECURSIVE {oracles.probe_ctes(False)} SELECT task_id, layer_idx, round(p, 6) AS p FROM scores")
def io11_probes_saved(spark: SparkSession, sf: str) -> DataFrame:
    acts, path = _activations(spark, sf), store.new_path(spark, "probes")
    probes.save(probes.train(acts.drop("label"), _labels(spark, sf)), path)
    return probes.probabilities(acts, probes.table(spark, probes.load(spark, path))).select("task_id", "layer_idx", F.round("p", 6).alias("p"))


@query(f"{WITH_SCORED} SELECT task_id, round(pei_score, 6) AS pei_score, round(pei_multiplicative, 6) AS pei_multiplicative FROM ranked")
def io15_extended_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    back = _round_trip(_index(spark, sf), store.EXTENDED)
    return rounded(back.select("task_id", "pei_score", "pei_multiplicative"), "pei_score", "pei_multiplicative")


@query(f"{WITH_FEATURES} SELECT task_id, n_boosters FROM features")
def io16_stage_reused(spark: SparkSession, sf: str) -> DataFrame:
    path = store.new_path(spark, "features")
    store.stage(spark, path, lambda: surface.features(_responses(spark, sf)))
    return store.stage(spark, path, lambda: _responses(spark, sf)).select("task_id", "n_boosters")


@query(f"{WITH_FEATURES} SELECT task_id, n_hedges AS n FROM features")
def io16_stage_made_again(spark: SparkSession, sf: str) -> DataFrame:
    path, docs = store.new_path(spark, "features"), inputs.table(spark, sf, "documents")
    made = lambda column, setting: store.stage(spark, path, lambda: surface.features(_responses(spark, sf)).select("task_id", F.col(column).alias("n")), [docs], counted=setting)
    made("n_boosters", "boosters")
    # Another setting makes the table again; the same one finds it as it is.
    made("n_hedges", "hedges")
    return made("n_sentences", "hedges")


@query("SELECT DISTINCT CAST(p_partkey AS BIGINT) AS p_partkey, array_to_string(list_sort(list_distinct([0, n // 4, n // 2, 3 * n // 4, n - 1])), ',') AS layers FROM (SELECT p_partkey, CAST(p_partkey % 80 + 1 AS INT) AS n FROM part)")
def m6_selected_layers(spark: SparkSession, sf: str) -> DataFrame:
    n = (F.col("p_partkey") % 80 + 1).cast("int")
    return inputs.table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.array_join(probes.selected_layers_of(n), ",").alias("layers"))


_CHAT = f"'<|im_start|>system' || chr(10) || {oracles.quoted(tasks.SYSTEM_MESSAGE)} || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"


@query(f"SELECT task_id, {_CHAT} AS prompt FROM ({_QA_SQL})")
def m2_chat_prompts(spark: SparkSession, sf: str) -> DataFrame:
    rows = tasks.question_answering(_qa_source(spark, sf), 2**31 - 1)
    return rows.select("task_id", tasks.chat_prompt(F.col("prompt")).alias("prompt"))


_SAID = f"SELECT task_id, CASE WHEN right(md5(task_id), 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'The answer is ' || ground_truth || '.' ELSE 'I am not sure.' END AS said FROM ({_QA_SQL})"


@query(f"SELECT task_id, {oracles.clean('said')} AS response FROM ({_SAID})")
def m4_generated_by_stub(spark: SparkSession, sf: str) -> DataFrame:
    return generate(tasks.question_answering(_qa_source(spark, sf), 2**31 - 1)).select("task_id", "response")


# Cleaning, extraction, matching

_NOISE = "SELECT CAST(doc_id AS STRING) AS task_id, concat('  ', CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'You are an AI assistant: ' WHEN 1 THEN '' ELSE 'x ' END, text, ' <|im_end|> You are a helpful assistant') AS response FROM {documents}"


@query(f"SELECT task_id, {oracles.clean('response')} AS response FROM {inputs.sql(_NOISE)}")
def cl1_clean_response(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.read(spark, sf, _NOISE).select("task_id", text.clean_response(F.col("response")).alias("response"))


@query(f"WITH j AS (SELECT * FROM {inputs.sql(inputs.ANSWERS)}),{oracles.factual_ctes('j')} SELECT task_id, answer FROM fa")
def ex1_factual_answer(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("task_id", answers.factual(F.col("response")).alias("answer"))


@query(f"SELECT task_id, {oracles.numerical('response')} AS answer FROM {inputs.sql(inputs.ANSWERS)}")
def ex2_numerical_answer(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("task_id", answers.numerical(F.col("response")).alias("answer"))


@query(f"SELECT task_id, {oracles.letter('response')} AS answer FROM {inputs.sql(inputs.ANSWERS)}")
def ex3_letter_answer(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("task_id", answers.letter(F.col("response")).alias("answer"))


@query(f"{WITH_JUDGED} SELECT task_id, extracted_answer AS answer FROM judged")
def ex4_extracted_by_domain(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select("task_id", answers.extracted(F.col("domain"), F.col("response")).alias("answer"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS task_id, {oracles.normalise('text')} AS normal FROM documents")
def nm1_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("task_id"), text.normalise(F.col("text")).alias("normal"))


def _judged_where(spark: SparkSession, sf: str, domain: str) -> DataFrame:
    return judging.judge(_answers(spark, sf)).where(F.col("domain") == domain).select("task_id", "is_correct")


@query(f"{WITH_JUDGED} SELECT task_id, is_correct FROM judged WHERE domain = 'factual_qa'")
def mt1_match_factual(spark: SparkSession, sf: str) -> DataFrame:
    return _judged_where(spark, sf, "factual_qa")


@query(f"{WITH_JUDGED} SELECT task_id, is_correct FROM judged WHERE domain = 'reasoning'")
def mt2_match_numerical(spark: SparkSession, sf: str) -> DataFrame:
    return _judged_where(spark, sf, "reasoning")


@query(f"{WITH_JUDGED} SELECT task_id, is_correct FROM judged WHERE domain = 'commonsense'")
def mt3_match_letter(spark: SparkSession, sf: str) -> DataFrame:
    return _judged_where(spark, sf, "commonsense")


@query(f"{WITH_JUDGED} SELECT domain, is_correct, count(*) AS n FROM judged GROUP BY ALL")
def mt4_matched_by_domain(spark: SparkSession, sf: str) -> DataFrame:
    return judging.judge(_answers(spark, sf)).groupBy("domain", "is_correct").agg(F.count("*").alias("n"))


@query(f"{WITH_JUDGED} SELECT task_id, domain, extracted_answer, is_correct FROM judged")
def jd1_judge(spark: SparkSession, sf: str) -> DataFrame:
    return judging.judge(_answers(spark, sf)).select("task_id", "domain", "extracted_answer", "is_correct")


@query(f"{WITH_JUDGED} SELECT domain, domain IS NULL AS overall, count(*) AS total, count(*) FILTER (is_correct) AS correct, count(*) FILTER (NOT is_correct) AS errors, round(avg(CASE WHEN is_correct THEN 1.0::DOUBLE ELSE 0 END), 6) AS correct_rate, round(avg(CASE WHEN is_correct THEN 0.0::DOUBLE ELSE 1 END), 6) AS error_rate FROM judged GROUP BY ROLLUP (domain)")
def jd2_judged_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(judging.judged_counts(judging.judge(_answers(spark, sf))), "correct_rate", "error_rate")


# Text features

_SETS = {"boosters": lexicon.BOOSTERS, "hedges": lexicon.HEDGES, "direct": lexicon.DIRECT_EVIDENCE, "indirect": lexicon.INDIRECT_EVIDENCE, "concessives": lexicon.CONCESSIVES}


@query(f"SELECT task_id, {', '.join(oracles.markers(oracles.letters('response'), 'lower(response)', ms) + ' AS n_' + k for k, ms in _SETS.items())} FROM {inputs.sql(inputs.RESPONSES)}")
def lx1_count_markers(spark: SparkSession, sf: str) -> DataFrame:
    found = markers.count_sets(F.col("response"), {f"n_{k}": ms for k, ms in _SETS.items()})
    return _responses(spark, sf).select("task_id", found.alias("found")).select("task_id", "found.*")


def _features(*columns: str, ratios: tuple[str, ...] = ()) -> tuple[str, Query]:
    names = ", ".join([*columns, *(f"round({c}, 6) AS {c}" for c in ratios)])
    return f"{WITH_FEATURES} SELECT task_id, {names} FROM features", lambda spark, sf: rounded(surface.features(_responses(spark, sf)).select("task_id", *columns, *ratios), *ratios)


for _name, _spec in {
    "lx2_epistemic": _features("n_boosters", "n_hedges", ratios=("booster_ratio",)),
    "lx3_evidentiality": _features("n_direct_evidence", "n_indirect_evidence", "n_bald_assertions"),
    "lx4_discourse": _features("claim_in_first_sentence", "n_concessive_structures", ratios=("definite_reference_ratio",)),
    "lx5_syntax": _features(ratios=("declarative_ratio", "active_voice_ratio")),
    "lx6_fluency": _features("n_sentences", "has_repetition", ratios=("mean_sentence_length",)),
    "lx7_confidence": _features(ratios=("lcs_score",)),
    "lx8_all_features": _features("domain", "n_boosters", "n_hedges", "n_direct_evidence", "n_indirect_evidence", "n_bald_assertions", "claim_in_first_sentence", "n_concessive_structures", "n_sentences", "has_repetition", ratios=("booster_ratio", "definite_reference_ratio", "declarative_ratio", "active_voice_ratio", "mean_sentence_length", "lcs_score")),
}.items():
    ORACLE_SQL[_name], QUERIES[_name] = _spec


_TOKEN = r"[\p{L}\p{N}]+(?:[.''-][\p{L}\p{N}]+)*\.?"
_LIKELY = "n_stops * ln({p}) + (n - n_stops) * ln(1 - {p})"


@query(rf"""WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS token FROM documents),
w AS (SELECT CASE WHEN suffix(token, '.') THEN left(token, length(token) - 1) ELSE token END AS word, count(*) AS n, count(*) FILTER (suffix(token, '.')) AS n_stops FROM t GROUP BY 1),
a AS (SELECT *, CAST(sum(n_stops) OVER () AS DOUBLE) / sum(n) OVER () AS share, length(word) - length(replace(word, '.', '')) AS inner_stops FROM w)
SELECT word, n, n_stops, round(-2 * (({_LIKELY.format(p="share")}) - ({_LIKELY.format(p="0.99::DOUBLE")})) * exp(-(length(word) - inner_stops)) * (inner_stops + 1) * pow(CAST(length(word) - inner_stops AS DOUBLE), -(n - n_stops)), 4) + 0.0::DOUBLE AS score
FROM a WHERE n_stops > 0 AND NOT regexp_matches(word, '^[\p{{N}}.''-]+$')""")
def lx5_abbreviation_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = abbreviations.scores(abbreviations.counts(inputs.table(spark, sf, "documents")))
    return out.withColumn("score", F.round("score", 4) + 0.0)


# Probes


@query("WITH c AS (SELECT CAST(label < 5 AS INT) AS label, count(*) AS n FROM embeddings GROUP BY 1), t AS (SELECT *, n * 0.2::DOUBLE AS x, CAST(ceil(round(sum(n) OVER () * 0.2::DOUBLE, 9)) AS BIGINT) AS total FROM c), q AS (SELECT *, CAST(floor(x) AS BIGINT) AS low, row_number() OVER (ORDER BY x - floor(x) DESC, label) AS r, CAST(sum(floor(x)) OVER () AS BIGINT) AS lows FROM t) SELECT CAST(label AS DOUBLE) AS label, low + CASE WHEN r <= total - lows THEN 1 ELSE 0 END AS n_held, n - (low + CASE WHEN r <= total - lows THEN 1 ELSE 0 END) AS n_rest FROM q")
def pb1_split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    split = probes.stratified_split(_labels(spark, sf), probes.TEST_SHARE)
    return split.groupBy("label").agg(F.count_if("held").alias("n_held"), F.count_if(~F.col("held")).alias("n_rest"))


@query("WITH x AS (SELECT vec_id, l, i, CAST(embedding[12 * l + i] AS DOUBLE) AS x, vec_id % 5 <> 0 AS train FROM embeddings, unnest(range(0, 5)) AS u(l), unnest(range(1, 13)) AS v(i)), s AS (SELECT l, i, avg(x) AS m, stddev_pop(x) AS sd FROM x WHERE train GROUP BY l, i) SELECT CAST(vec_id AS VARCHAR) AS task_id, CAST(l AS INT) AS layer_idx, round(sum((x - m) / sd), 4) AS total FROM x JOIN s USING (l, i) GROUP BY vec_id, l")
def pb2_standardised(spark: SparkSession, sf: str) -> DataFrame:
    acts = _activations(spark, sf).withColumn("act", F.col("act").cast("array<double>"))
    out = probes.standardised(acts, acts.where(F.col("task_id").cast("long") % 5 != 0))
    return out.select("task_id", "layer_idx", F.round(F.aggregate("act", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"WITH RECURSIVE {oracles.probe_ctes(False)} SELECT * FROM probes")
def pb3_probe_results(spark: SparkSession, sf: str) -> DataFrame:
    acts = _activations(spark, sf).drop("label")
    return rounded(probes.results(spark, probes.train(acts, _labels(spark, sf))), "accuracy", "auc")


@query("SELECT round(avg(CASE WHEN (embedding[1] > 0) = (label < 5) THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM embeddings")
def pb4_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.table(spark, sf, "embeddings").select((F.col("embedding")[0] > 0).cast("double").alias("prediction"), (F.col("label") < 5).cast("double").alias("label"))
    return rounded(probes.accuracy(rows), "accuracy")


@query(f"WITH x AS (SELECT CAST(label < 5 AS INT) AS y, round(CAST(embedding[1] AS DOUBLE), 2) AS s FROM embeddings), r AS (SELECT y, {oracles.average_rank('s')} AS r FROM x) SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r")
def pb5_auc(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.table(spark, sf, "embeddings").select((F.col("label") < 5).cast("double").alias("label"), F.round(F.col("embedding")[0].cast("double"), 2).alias("score"))
    return rounded(stats.auc(rows, "label", "score"), "auc")


def _internal(spark: SparkSession, sf: str, calibrated: bool) -> DataFrame:
    acts, labels = _activations(spark, sf).drop("label"), _labels(spark, sf)
    fitted = probes.train(acts, labels, calibrated=calibrated)
    judged = labels.select("task_id", F.lit("all").alias("domain"), (F.col("label") == 1).alias("is_correct"))
    out = probes.internal_scores(acts, judged, fitted)
    layers = [F.round(F.col("layer_scores")[p.layer], 6).alias(f"layer_{p.layer}") for p in fitted]
    return out.select("task_id", "is_correct", *layers, F.round("isd_score", 6).alias("isd_score"))


def _internal_sql(calibrated: bool) -> str:
    layers = ", ".join(f"round(max(p) FILTER (layer_idx = {i}), 6) AS layer_{i}" for i in range(5))
    return f"WITH RECURSIVE {oracles.probe_ctes(calibrated)} SELECT task_id, y = 1 AS is_correct, {layers}, round(avg(p), 6) AS isd_score FROM scores GROUP BY task_id, y"


@query(_internal_sql(False))
def is1_internal_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _internal(spark, sf, False)


@query(f"WITH RECURSIVE {oracles.probe_ctes(True)} SELECT * FROM probes")
def cb1_calibrated_probes(spark: SparkSession, sf: str) -> DataFrame:
    acts = _activations(spark, sf).drop("label")
    return rounded(probes.results(spark, probes.train(acts, _labels(spark, sf), calibrated=True)), "accuracy", "auc")


@query(f"WITH RECURSIVE e AS (SELECT 0 AS l, CAST(embedding[1] AS DOUBLE) AS margin, CAST(label < 5 AS INT) AS y FROM embeddings), {oracles.sigmoid_ctes('s', 'e')} SELECT round(a, 6) AS slope, round(b, 6) AS intercept FROM s")
def cb2_platt(spark: SparkSession, sf: str) -> DataFrame:
    margins = inputs.table(spark, sf, "embeddings").select(F.col("embedding")[0].cast("double").alias("margin"), (F.col("label") < 5).cast("double").alias("label"))
    slope, intercept = probes.platt(margins)
    return spark.createDataFrame([(round(slope, 6), round(intercept, 6))], "slope double, intercept double")


@query(_internal_sql(True))
def cb3_calibrated_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _internal(spark, sf, True)


@query(f"WITH isd AS (SELECT * FROM {inputs.sql(inputs.ISD)}) SELECT is_correct, count(*) AS n, round(avg(isd_score), 6) AS mean, round(stddev_pop(isd_score), 6) AS std FROM isd GROUP BY is_correct")
def cb4_separation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.separation(_isd(spark, sf)), "mean", "std")


# Composite

_SCORES = "round(isd_score, 6) AS isd_score, round(lcs_score, 6) AS lcs_score"


@query(f"{WITH_SCORED} SELECT task_id, domain, is_correct, {_SCORES} FROM scored")
def cp1_joined(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_scored(spark, sf), "isd_score", "lcs_score")


@query(f"{WITH_SCORED} SELECT task_id, domain FROM errors")
def cp2_errors_only(spark: SparkSession, sf: str) -> DataFrame:
    return composite.errors_only(_scored(spark, sf)).select("task_id", "domain")


@query(f"{WITH_SCORED} SELECT task_id, {_SCORES} FROM scaled")
def cp3_min_max(spark: SparkSession, sf: str) -> DataFrame:
    out = composite.normalised(composite.errors_only(_scored(spark, sf)), ["isd_score", "lcs_score"])
    return rounded(out.select("task_id", "isd_score", "lcs_score"), "isd_score", "lcs_score")


@query(f"{WITH_SCORED} SELECT task_id, round(({oracles.average_rank('lcs_score')} - 1) / (count(*) OVER () - 1), 6) AS lcs_score FROM errors")
def cp4_percentile(spark: SparkSession, sf: str) -> DataFrame:
    out = composite.normalised(composite.errors_only(_scored(spark, sf)), ["lcs_score"], "percentile")
    return rounded(out.select("task_id", "lcs_score"), "lcs_score")


@query(f"{WITH_SCORED} SELECT task_id, round(pei_score, 6) AS pei_score FROM ranked")
def cp6_additive(spark: SparkSession, sf: str) -> DataFrame:
    out = composite.normalised(composite.errors_only(_scored(spark, sf)), ["isd_score", "lcs_score"])
    return out.select("task_id", F.round(composite.additive(F.col("isd_score"), F.col("lcs_score")), 6).alias("pei_score"))


@query(f"{WITH_SCORED} SELECT task_id, domain, is_correct, {_SCORES}, round(pei_score, 6) AS pei_score, pei_rank FROM ranked")
def cp7_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_index(spark, sf).drop("pei_multiplicative"), "isd_score", "lcs_score", "pei_score")


@query(f"{WITH_SCORED} SELECT task_id, pei_rank FROM ranked WHERE false")
def cp8_empty(spark: SparkSession, sf: str) -> DataFrame:
    return composite.index(_isd(spark, sf).where("is_correct"), _lcs(spark, sf)).select("task_id", "pei_rank")


_LONG = f"SELECT isd.task_id, isd.domain, len({oracles.blank_words('r.response')}) >= 20 AS long FROM isd JOIN {inputs.sql(inputs.RESPONSES)} r USING (task_id)"


@query(f"{WITH_SCORED} SELECT task_id FROM ({_LONG}) WHERE long")
def cp9_long_enough(spark: SparkSession, sf: str) -> DataFrame:
    return composite.long_enough(_isd(spark, sf), _responses(spark, sf)).select("task_id")


@query(f"{WITH_SCORED} SELECT domain, count(*) AS n_excluded FROM ({_LONG}) WHERE NOT long GROUP BY domain")
def cp10_excluded(spark: SparkSession, sf: str) -> DataFrame:
    isd = _isd(spark, sf)
    return composite.excluded_by_domain(isd, composite.long_enough(isd, _responses(spark, sf)))


@query(f"{WITH_SCORED} SELECT task_id, round(pei_multiplicative, 6) AS pei_multiplicative FROM ranked")
def cp11_multiplicative(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_index(spark, sf).select("task_id", "pei_multiplicative"), "pei_multiplicative")


@query(f"{WITH_SCORED}, k AS (SELECT *, {oracles.average_rank('pei_score')} AS ra, {oracles.average_rank('pei_multiplicative')} AS rm FROM ranked) SELECT round(corr(pei_score, pei_multiplicative), 6) AS pearson, round(corr(ra, rm), 6) AS spearman FROM k")
def cp12_composition_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(composite.composition_correlation(_index(spark, sf)), "pearson", "spearman")


@query(f"{WITH_SCORED} SELECT task_id, pei_rank, round(abs(pei_score - pei_multiplicative), 6) AS disagreement FROM ranked ORDER BY abs(pei_score - pei_multiplicative) DESC, pei_rank LIMIT 20")
def cp13_disagreement(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(composite.disagreement(_index(spark, sf)).select("task_id", "pei_rank", "disagreement"), "disagreement")


@query(f"{WITH_SCORED} SELECT round(max(pei_score), 6) AS top, round(min(pei_score), 6) AS bottom, round(avg(pei_score), 6) AS mean FROM ranked")
def cp14_extremes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(composite.extremes(_index(spark, sf)), "top", "bottom", "mean")


@query(f"{WITH_SCORED} SELECT isd.task_id, round(pei_multiplicative, 6) AS pei_multiplicative FROM isd LEFT JOIN ranked USING (task_id)")
def cp15_attached(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(composite.attached(_isd(spark, sf).select("task_id"), _index(spark, sf), "pei_multiplicative"), "pei_multiplicative")


@query(f"WITH isd AS (SELECT * FROM {inputs.sql(inputs.ISD)}) SELECT count(*) AS n, count(*) FILTER (NOT is_correct) AS errors, count(*) FILTER (is_correct) AS correct, round(avg(CASE WHEN is_correct THEN 0.0::DOUBLE ELSE 1 END), 6) AS error_rate FROM isd")
def cp16_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(judging.label_counts(_isd(spark, sf)), "error_rate")


# Analysis


def _kruskal_sql(group: str, value: str, source: str) -> str:
    return f"k0 AS (SELECT {group} AS g, {value} AS v FROM {source} WHERE {value} IS NOT NULL), k1 AS (SELECT *, {oracles.average_rank('v')} AS r FROM k0), k2 AS (SELECT g, count(*)::DOUBLE AS c, sum(r) AS r FROM k1 GROUP BY g), k3 AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM k0 GROUP BY v)), k4 AS (SELECT sum(c) AS n, count(*) AS groups, sum(r * r / c) AS s FROM k2), kh AS (SELECT CAST(n AS BIGINT) AS n, groups, (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM k4, k3)"


@query(f"{WITH_SCORED} SELECT count(*) AS n, round(avg(pei_score), 6) AS mean, round(stddev_samp(pei_score), 6) AS std, round(median(pei_score), 6) AS median, round(corr(isd_score, lcs_score), 6) AS isd_lcs_correlation FROM ranked")
def an2_overall_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.overall_summary(_index(spark, sf)), "mean", "std", "median", "isd_lcs_correlation")


@query(f"{WITH_SCORED} SELECT domain, count(*) AS n, round(avg(pei_score), 6) AS mean, round(stddev_samp(pei_score), 6) AS std FROM ranked GROUP BY domain")
def an3_domain_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.domain_summary(_index(spark, sf)), "mean", "std")


@query(f"WITH {_kruskal_sql('c_mktsegment', 'c_acctbal', 'customer')} SELECT n, groups, round(h, 6) AS h, round(exp(-h / 2) * (1 + h / 2), 6) AS p FROM kh")
def an4_kruskal(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.table(spark, sf, "customer").select("c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    return rounded(stats.kruskal_test(stats.ranking(rows, "c_mktsegment", "c_acctbal")), "h", "p")


@query(f"{WITH_SCORED}, x AS (SELECT count(*) AS n_excluded FROM ({_LONG}) WHERE NOT long) SELECT count(*) AS n_errors, round(avg(pei_score), 6) AS additive_mean, round(stddev_samp(pei_score), 6) AS additive_std, round(median(pei_score), 6) AS additive_median, round(avg(pei_multiplicative), 6) AS multiplicative_mean, round(stddev_samp(pei_multiplicative), 6) AS multiplicative_std, round(corr(isd_score, lcs_score), 6) AS isd_lcs_correlation, round(corr(pei_score, pei_multiplicative), 6) AS composition_correlation, any_value(n_excluded) AS n_excluded, round((SELECT avg(isd_score) FROM isd WHERE is_correct), 6) AS isd_mean_correct, round((SELECT avg(isd_score) FROM isd WHERE NOT is_correct), 6) AS isd_mean_errors FROM ranked, x")
def an5_extended_summary(spark: SparkSession, sf: str) -> DataFrame:
    isd = _isd(spark, sf)
    gone = composite.excluded_by_domain(isd, composite.long_enough(isd, _responses(spark, sf)))
    out = reports.extended_summary(_index(spark, sf), gone, isd)
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


def _showcase_sql(extra: str = "") -> str:
    short = lambda c, n: f"CASE WHEN length({c}) > {n} THEN substr({c}, 1, {n}) || '...' ELSE {c} END"
    return f"{WITH_SCORED}, {oracles.judged_ctes()}, b AS (SELECT *, row_number() OVER (ORDER BY pei_rank) AS top, row_number() OVER (ORDER BY pei_rank DESC) AS low FROM ranked), s AS (SELECT 'high' AS bucket, CAST(top AS INT) AS pos, * FROM b WHERE top <= 5 UNION ALL SELECT 'low', CAST(row_number() OVER (ORDER BY pei_rank) AS INT), * FROM b WHERE low <= 5) SELECT bucket, pos, s.task_id, s.domain, round(pei_score, 3) AS pei_score, round(isd_score, 3) AS isd_score, round(lcs_score, 3) AS lcs_score, {extra} {short('prompt', 200)} AS prompt, {short('response', 300)} AS response, ground_truth, extracted_answer FROM s JOIN judged USING (task_id)"


@query(_showcase_sql())
def an6_showcase(spark: SparkSession, sf: str) -> DataFrame:
    return reports.showcase(_index(spark, sf).drop("pei_multiplicative"), judging.judge(_answers(spark, sf)))


@query(_showcase_sql("round(pei_multiplicative, 3) AS pei_multiplicative,"))
def an10_extended_showcase(spark: SparkSession, sf: str) -> DataFrame:
    return reports.showcase(_index(spark, sf), judging.judge(_answers(spark, sf)))


@query("SELECT CAST(doc_id AS VARCHAR) AS task_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS prompt FROM documents")
def an8_shortened(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("task_id"), reports.shortened(F.col("text"), 200).alias("prompt"))


@query("SELECT DISTINCT lang AS domain FROM documents")
def an11_domains(spark: SparkSession, sf: str) -> DataFrame:
    return stats.domains(inputs.table(spark, sf, "documents").select(F.col("lang").alias("domain")))


# Figures


def _bins_sql(source: str, value: str, bins: int, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    key = f"{by}, " if by else ""
    return f"b AS (SELECT {key}{value} AS v, min({value}) OVER ({part}) AS lo, max({value}) OVER ({part}) AS hi FROM {source}) SELECT {key}CAST(least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1}) AS INT) AS bin, round(lo + CAST(least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1}) AS INT) * (hi - lo) / {bins}, 6) AS low, count(*) AS n FROM b GROUP BY ALL"


@query(f"{WITH_SCORED}, {_bins_sql('ranked', 'pei_score', 30)}")
def fg1_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.histogram(_index(spark, sf), "pei_score", 30), "low")


@query("WITH b AS (SELECT c_mktsegment AS domain, CAST(c_acctbal AS DOUBLE) AS v FROM customer), " + _bins_sql("b", "v", 20, "domain").replace("b AS", "c AS", 1).replace("FROM b GROUP", "FROM c GROUP"))
def fg1_by_domain(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("domain"), F.col("c_acctbal").cast("double").alias("v"))
    return rounded(stats.histogram(rows, "v", 20, "domain"), "low")


_QUADRANT = "CASE WHEN isd_score >= 0.5 THEN 'high_isd' ELSE 'low_isd' END || '_' || CASE WHEN lcs_score >= 0.5 THEN 'high_lcs' ELSE 'low_lcs' END"


@query(f"{WITH_SCORED} SELECT {_QUADRANT} AS quadrant, count(*) AS n FROM ranked GROUP BY 1")
def fg2_quadrants(spark: SparkSession, sf: str) -> DataFrame:
    return stats.quadrants(_index(spark, sf))


@query(f"WITH RECURSIVE {oracles.probe_ctes(False)}, bars AS (SELECT layer_idx, 'Accuracy' AS measure, accuracy AS value FROM probes UNION ALL SELECT layer_idx, 'AUC', auc FROM probes) SELECT layer_idx, measure, value, round(value - 0.5::DOUBLE, 6) AS above_chance, value BETWEEN 0.4 AND 1.0 AS on_axis FROM bars")
def fg3_probe_bars(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(reports.probe_bars(pb3_probe_results(spark, sf)), "above_chance")


@query(f"{WITH_SCORED}, {_bins_sql('isd', 'isd_score', 30, 'is_correct')}")
def fg4_isd_by_correctness(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.histogram(_isd(spark, sf), "isd_score", 30, "is_correct"), "low")


@query(f"{WITH_SCORED}, {_bins_sql('ranked', 'pei_multiplicative', 30)}")
def fg5_multiplicative(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.histogram(_index(spark, sf), "pei_multiplicative", 30), "low")


@query(f"{WITH_SCORED} SELECT task_id, domain, round(pei_score, 6) AS pei_score, round(pei_multiplicative, 6) AS pei_multiplicative FROM ranked")
def fg6_composites(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_index(spark, sf).select("task_id", "domain", "pei_score", "pei_multiplicative"), "pei_score", "pei_multiplicative")


# The whole index on real features


@query(f"WITH {oracles.features_ctes()}, isd AS (SELECT * FROM {inputs.sql(inputs.ISD)}), e AS (SELECT isd.task_id, isd.domain, isd_score, lcs_score FROM isd JOIN features USING (task_id) WHERE NOT is_correct), n AS (SELECT task_id, domain, (isd_score - min(isd_score) OVER ()) / (max(isd_score) OVER () - min(isd_score) OVER ()) AS isd_score, (lcs_score - min(lcs_score) OVER ()) / (max(lcs_score) OVER () - min(lcs_score) OVER ()) AS lcs_score FROM e) SELECT task_id, domain, round(isd_score, 6) AS isd_score, round(lcs_score, 6) AS lcs_score, round(0.5::DOUBLE * isd_score + 0.5::DOUBLE * lcs_score, 6) AS pei_score FROM n")
def index_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    out = composite.index(_isd(spark, sf), surface.features(_responses(spark, sf)))
    return rounded(out.select("task_id", "domain", "isd_score", "lcs_score", "pei_score"), "isd_score", "lcs_score", "pei_score")
