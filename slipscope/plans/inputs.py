"""Input relations of the registered queries, as SQL that Spark and DuckDB both read.

The tables at hand hold no model responses: documents stand in for responses, embeddings for hidden states, labels for
correctness. Names in braces are tables; {i} is the index of an array's first element.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["documents", "labels", "embeddings", "conversations", "benchmark", "customer", "part", "lineitem"]

#: Documents with markers in front, which their prose lacks.
RESPONSES = """
SELECT CAST(doc_id AS STRING) AS task_id, lang AS domain, concat(CASE CAST(doc_id % 6 AS INT)
    WHEN 0 THEN 'Certainly, in fact, '
    WHEN 1 THEN 'Perhaps it might be that '
    WHEN 2 THEN 'Studies show that '
    WHEN 3 THEN 'However, it is said that '
    WHEN 4 THEN 'I think it was never confirmed. Was it broken? '
    ELSE '' END, text) AS response
FROM {documents}
"""

#: Responses of three domains with truths, one alias each, and every way of answering.
ANSWERS = """
SELECT CAST(doc_id AS STRING) AS task_id, d AS domain, text AS prompt, w3 AS alias,
  CASE d WHEN 'factual_qa' THEN concat(w1, ' ', w2) WHEN 'reasoning' THEN CAST(doc_id AS STRING) ELSE c END AS ground_truth,
  CASE concat(d, CAST(v AS STRING))
    WHEN 'factual_qa0' THEN concat('Let me think.', chr(10), 'In short: ', w1, ' ', w2, '!')
    WHEN 'factual_qa1' THEN concat('The answer is A: ', w1, ' ', w2, ';')
    WHEN 'factual_qa2' THEN concat(w1, ' ', w2, ' ', w3, ' ', w4, ' was said to be ', w5, ' but it is ', w3)
    WHEN 'factual_qa3' THEN concat('The ', w1, ' peak ON that long list IS ', w2, ' ', w3, ', they say.')
    WHEN 'factual_qa4' THEN concat('In short:', chr(10), 'Simply put, ', w2, ' ', w3, '.')
    WHEN 'factual_qa5' THEN '  '
    WHEN 'reasoning0' THEN concat('The answer is $', CAST(doc_id AS STRING), ',250.50.')
    WHEN 'reasoning1' THEN concat('The answer is ', CAST(doc_id AS STRING))
    WHEN 'reasoning2' THEN concat('Total is ', CAST(doc_id AS STRING), '. So, done')
    WHEN 'reasoning3' THEN concat('The answer is -', CAST(doc_id AS STRING))
    WHEN 'reasoning4' THEN concat('the answer is: ', CAST(doc_id AS STRING), ' or ', CAST(doc_id + 1 AS STRING))
    WHEN 'commonsense0' THEN concat('(', c, ') because')
    WHEN 'commonsense1' THEN concat(c, '.')
    WHEN 'commonsense2' THEN lower(c)
    WHEN 'commonsense3' THEN 'I found it'
    WHEN 'commonsense4' THEN concat('The answer is ', c)
    ELSE text END AS response
FROM (
  SELECT doc_id, text, CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'factual_qa' WHEN 1 THEN 'reasoning' ELSE 'commonsense' END AS d,
    CAST(floor(doc_id / 3) AS BIGINT) % 6 AS v, chr(CAST(65 + doc_id % 4 AS INT)) AS c,
    split_part(text, ' ', 1) AS w1, split_part(text, ' ', 2) AS w2, split_part(text, ' ', 3) AS w3, split_part(text, ' ', 4) AS w4, split_part(text, ' ', 5) AS w5
  FROM {documents}) AS x
"""

#: Hidden-state scores: the mean of five clamped components.
ISD = """
SELECT CAST(e.vec_id AS STRING) AS task_id, d.lang AS domain, e.label < 5 AS is_correct, (
  least(greatest(0.5 + CAST(e.embedding[{i} + 0] AS DOUBLE) / 2, 0), 1) + least(greatest(0.5 + CAST(e.embedding[{i} + 7] AS DOUBLE) / 2, 0), 1)
  + least(greatest(0.5 + CAST(e.embedding[{i} + 14] AS DOUBLE) / 2, 0), 1) + least(greatest(0.5 + CAST(e.embedding[{i} + 21] AS DOUBLE) / 2, 0), 1)
  + least(greatest(0.5 + CAST(e.embedding[{i} + 27] AS DOUBLE) / 2, 0), 1)) / 5 AS isd_score
FROM {embeddings} e JOIN {documents} d ON d.doc_id = e.vec_id
"""

#: Text scores with many ties.
LCS = "SELECT CAST(doc_id AS STRING) AS task_id, CAST(n_chars % 97 AS DOUBLE) / 97 AS lcs_score FROM {documents}"


def sql(text: str) -> str:
    """The relation as a DuckDB subquery."""
    return "(" + text.format(i=1, **{t: t for t in TABLES}) + ")"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The relation as a DataFrame."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text.replace("{i}", "0"), **used)
