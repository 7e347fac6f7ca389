"""The staged run: judge, probe, features, index, analyse. Stages read and write tables, so each can run alone."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_response
from ..operators import composite, judging, probes, reports, surface
from ..sources import store, tasks

STAGES = ["generate", "judge", "probe", "linguistic", "pei", "analyse"]


@dataclass(frozen=True)
class Config:
    """Parameters of a run. Unknown keys of a file are ignored, as are those of parts that need a model."""

    n_samples: dict[str, int] = field(default_factory=lambda: {"factual_qa": 1500, "reasoning": 1000, "commonsense": 1000})
    test_split: float = 0.2
    random_seed: int = 42
    isd_weight: float = 0.5
    lcs_weight: float = 0.5
    normalisation: str = "min_max"
    calibrated: bool = False
    min_words: int = 0
    results_dir: str = "results"

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> Config:
        pick = lambda part, **names: {ours: d[part][theirs] for ours, theirs in names.items() if theirs in (d.get(part) or {})}
        sizes = {k: v["n_samples"] for k, v in (d.get("tasks") or {}).items() if "n_samples" in v}
        return cls(
            **({"n_samples": sizes} if sizes else {}),
            **pick("probing", test_split="test_split", random_seed="random_seed", calibrated="calibrated"),
            **pick("pei", isd_weight="isd_weight", lcs_weight="lcs_weight", normalisation="normalisation", min_words="min_words"),
            **pick("output", results_dir="results_dir"),
        )

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        import yaml

        with open(path) as f:
            return cls.from_dict(yaml.safe_load(f) or {})


class Generator(Protocol):
    """Adds ``response`` to tasks; a language model would run in mapInPandas behind this."""

    def __call__(self, tasks: DataFrame) -> DataFrame: ...


def echo(tasks: DataFrame) -> DataFrame:
    """A deterministic stand-in for a model: states the truth for even hashes, and nothing else for odd ones."""
    even = F.substring(F.md5("task_id"), 32, 1).isin(*"02468ace")
    return tasks.withColumn("response", F.when(even, F.concat(F.lit("The answer is "), "ground_truth", F.lit("."))).otherwise("I am not sure."))


def generate(task_rows: DataFrame, generator: Generator = echo) -> DataFrame:
    out = generator(task_rows)
    return out.withColumn("response", clean_response(F.col("response")))


#: What each stage reads, and the tables that it writes; the last of them is stamped when all are written.
READS = {"judge": ["responses.jsonl"], "probe": ["judged.jsonl", "activations"], "linguistic": ["judged.jsonl"], "pei": ["isd_scores.jsonl", "linguistic_features.jsonl", "judged.jsonl"]}
WRITES = {"judge": ["judged.jsonl"], "probe": ["probes", "probe_results.jsonl", "isd_scores.jsonl"], "linguistic": ["linguistic_features.jsonl"], "pei": ["pei_scores.jsonl"]}
#: Settings that a stage's result depends on.
SETTINGS = {"judge": [], "probe": ["test_split", "random_seed", "calibrated"], "linguistic": [], "pei": ["isd_weight", "lcs_weight", "normalisation", "min_words"]}


class Run:
    """Stages over tables in one folder."""

    def __init__(self, spark: SparkSession, config: Config = Config()):
        self.spark, self.config, self.dir = spark, config, config.results_dir

    def _read(self, name: str, schema: str) -> DataFrame:
        return store.read_jsonl(self.spark, f"{self.dir}/{name}.jsonl", schema)

    def generate(self, sources: dict[str, DataFrame], generator: Generator = echo) -> None:
        rows = tasks.load_tasks(sources, self.config.n_samples)
        store.write_jsonl(generate(rows, generator), f"{self.dir}/responses.jsonl")

    def _made_of(self, name: str) -> str:
        read = lambda f: self.spark.read.text(f"{self.dir}/{f}") if f.endswith(".jsonl") else self.spark.read.parquet(f"{self.dir}/{f}")
        return store.fingerprint(self.spark, [read(f) for f in READS[name]], stage=name, **{k: getattr(self.config, k) for k in SETTINGS[name]})

    def once(self, name: str) -> bool:
        """Run a stage, unless its tables were made of the same files with the same settings; whether it ran."""
        wanted = self._made_of(name)
        last = f"{self.dir}/{WRITES[name][-1]}"
        if store.stamped(self.spark, last) == wanted:
            return False
        getattr(self, name)()
        store.stamp(self.spark, last, wanted)
        return True

    def judge(self) -> DataFrame:
        store.write_jsonl(judging.judge(self._read("responses", store.RESPONSES)), f"{self.dir}/judged.jsonl")
        return judging.judged_counts(self._read("judged", store.JUDGED))

    def probe(self) -> list[probes.Probe]:
        judged = self._read("judged", store.JUDGED)
        acts = store.read_activations(self.spark, f"{self.dir}/activations")
        fitted = probes.train(acts, judged.select("task_id", F.col("is_correct").cast("double").alias("label")), calibrated=self.config.calibrated, seed=self.config.random_seed, test_share=self.config.test_split)
        probes.save(fitted, f"{self.dir}/probes")
        store.write_jsonl(probes.results(self.spark, fitted), f"{self.dir}/probe_results.jsonl")
        store.write_jsonl(probes.internal_scores(acts, judged, fitted), f"{self.dir}/isd_scores.jsonl")
        return fitted

    def linguistic(self) -> None:
        store.write_jsonl(surface.features(self._read("judged", store.JUDGED)), f"{self.dir}/linguistic_features.jsonl")

    def pei(self) -> None:
        c = self.config
        isd, lcs = self._read("isd_scores", store.ISD), self._read("linguistic_features", store.FEATURES)
        scored = composite.extended_index(isd, lcs, self._read("judged", store.JUDGED), c.min_words, isd_weight=c.isd_weight, lcs_weight=c.lcs_weight, method=c.normalisation)
        store.write_jsonl(scored, f"{self.dir}/pei_scores.jsonl", order="pei_rank")

    def analyse(self) -> dict[str, DataFrame]:
        scored, judged = self._read("pei_scores", store.EXTENDED), self._read("judged", store.JUDGED)
        overall, by_domain = reports.summary(scored)
        bars = reports.probe_bars(self._read("probe_results", store.PROBES))
        return {"overall": overall, "by_domain": by_domain, "showcase": reports.showcase(scored, judged), "probe_accuracy": bars, **reports.figures(scored, self._read("isd_scores", store.ISD))}

    def report(self) -> None:
        """The analysis as files: summary and examples in one, and a table for each figure."""
        out = self.analyse()
        small = ("overall", "by_domain", "showcase", "probe_accuracy")
        store.write_report(self.spark, f"{self.dir}/report.json", **{k: out[k] for k in small})
        for name, rows in out.items():
            if name not in small:
                store.write_jsonl(rows, f"{self.dir}/figures/{name}.jsonl")


def sources(spark: SparkSession, given: list[str]) -> dict[str, DataFrame]:
    """Source tables from DOMAIN=PATH; JSON Lines by their ending, else Parquet."""
    out = {}
    for domain, path in (g.split("=", 1) for g in given):
        out[domain] = spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)
    return out


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Run one stage, or all; generation needs sources, and is left out of all where none are given.")
    parser.add_argument("--stage", choices=[*STAGES, "all"], default="all")
    parser.add_argument("--config", help="YAML file")
    parser.add_argument("--source", action="append", default=[], metavar="DOMAIN=PATH", help="questions of a domain, by which generation begins")
    parser.add_argument("--calibrated", action="store_true", help="calibrate the probes")
    parser.add_argument("--min-words", type=int, help="leave out shorter responses")
    parser.add_argument("--resume", action="store_true", help="leave out stages whose tables were made of the same files with the same settings")
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    config = Config.from_yaml(given.config) if given.config else Config()
    config = replace(config, calibrated=config.calibrated or given.calibrated, min_words=config.min_words if given.min_words is None else given.min_words)
    run = Run(spark, config)
    stages = [s for s in STAGES if s != "generate" or given.source] if given.stage == "all" else [given.stage]
    for stage in stages:
        if stage == "generate":
            if not given.source:
                parser.error("generation needs --source")
            run.generate(sources(spark, given.source))
        elif stage == "analyse":
            run.report()
        elif given.resume:
            run.once(stage)
        else:
            getattr(run, stage)()


if __name__ == "__main__":
    main()
