"""python -m strandlab COMMAND: the data part of each experiment, with the experiments' defaults.

Making data: corpus, dyck, longrange, pretraining (packed blocks), pilot, distribution, backbone and bidirectional
(train and test splits of pairs for each seed), remote (mixtures of two sources), structural (fractions of tasks), forward (a fixed
sample). Reading what models gave: evaluate (predictions), sentence, crossmodal, ablation and transfer (predictions, as the
records that report reads), dynamics (predictions by step), cka and probe (hidden states), heads, forward_heads and
selectivity (attention). report: the tables of all records. Options of training itself (epochs, bs, lr, ...)
are taken and handed on in the records' settings file, but nothing is trained here.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab import schemas
from strandlab.config import DEFAULTS, TASKS
from strandlab.functions import tokenize
from strandlab.functions.scalars import diff_positions, tokenizer
from strandlab.operators import corpus, metrics, represent, sampling, sequences, stats, tasks
from strandlab.plans import reports
from strandlab.session import session
from strandlab.sources import readers, sinks

#: Rows of a test split, and of the fixed sample.
N_TEST, N_SAMPLE = 2000, 3000


def build_corpora(spark: SparkSession, a: argparse.Namespace) -> None:
    """A token-capped text file for each group, in hash order, and a manifest; sources of groups not asked for aren't read."""
    groups, made = a.groups.split(","), None
    for group in groups:
        if group == "text":
            rows = corpus.clean(readers.lines(spark, a.texts)).withColumn("seq_id", F.xxhash64("text"))
        else:
            rows = sequences.corpus_lines(readers.fasta(spark, a.fasta), group, a.seed)
        rows = rows.withColumn("key", sampling.hash_key(a.seed, "seq_id"))
        count = F.size(tokenizer(a.tokenizer)(F.col("text"))).cast("long")
        one = sinks.write_capped(rows, f"{a.out}/cpt_{group}", ["key", "seq_id"], F.substring("key", 1, 3), count, a.target_tokens).withColumn("group", F.lit(group))
        made = one if made is None else made.unionByName(one)
    sinks.write_manifest(made, f"{a.out}/manifest", a.target_tokens, a.seed)


def _with_splits(a: argparse.Namespace, examples) -> DataFrame:
    ids = a.n_train + a.n_val
    return examples(ids).withColumn("split", F.when(F.col("id") < a.n_train, "train").otherwise("val")).drop("id")


def build_dyck(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _with_splits(a, lambda n: tasks.bracket_task(spark.range(n), length=a.length, n_types=a.n_types, seed=a.seed))
    sinks.write_task(rows, f"{a.out}/dyck_L{a.length}_t{a.n_types}")


def build_longrange(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _with_splits(a, lambda n: tasks.agreement_task(spark.range(n), n_distract=a.n_distract, seed=a.seed))
    sinks.write_task(rows, f"{a.out}/longrange_d{a.n_distract}")


def build_blocks(spark: SparkSession, a: argparse.Namespace) -> None:
    """A corpus as blocks of tokens, packed within batches of a thousand lines in hash order."""
    rows = readers.lines(spark, a.corpus).filter("text <> ''").withColumn("key", sampling.hash_key(a.seed, "text"))
    place = sampling.shuffled_rank(rows.select("key", "text"), a.seed, "text")
    rows = place.select("rank", tokenizer(a.tokenizer)(F.col("text")).alias("tokens"))
    corpus.packed(rows, F.floor((F.col("rank") - 1) / 1000), ["rank"], "tokens", a.block).write.mode("overwrite").parquet(f"{a.out}/blocks")


def _identified(pairs: DataFrame) -> DataFrame:
    """Rows with an id of their content, as pairs carry none."""
    return pairs.withColumn("example_id", F.xxhash64(*pairs.columns))


def _seeds(a: argparse.Namespace) -> list[int]:
    """The seeds of a command: start to start + n_seeds - 1, or its one seed."""
    return list(range(getattr(a, "start", 0), getattr(a, "start", 0) + a.n_seeds)) if hasattr(a, "n_seeds") else [a.seed]


def build_splits(spark: SparkSession, a: argparse.Namespace) -> None:
    """A split for each seed from one scan, in a folder for each seed and split."""
    rows = sampling.splits(_identified(readers.pairs_csv(spark, a.pairs)), _seeds(a), a.n_test, "example_id")
    rows.write.mode("overwrite").partitionBy("seed", "split").parquet(f"{a.out}/pairs")


def build_mixture(spark: SparkSession, a: argparse.Namespace) -> None:
    """A mixture for each seed, split for training and testing."""
    remote, standard = (_identified(readers.pairs_csv(spark, x)) for x in (a.remote_pairs, a.pairs))
    rows = sampling.mixtures(remote, standard, _seeds(a), a.n_source, a.mix_remote, a.n_test, "example_id")
    rows.write.mode("overwrite").partitionBy("seed", "split").parquet(f"{a.out}/mixture")


def build_fractions(spark: SparkSession, a: argparse.Namespace) -> None:
    """Each task's training rows by fraction, and its validation rows whole; tasks whose folder is missing are left out."""
    for name in a.tasks.split(","):
        task, folder = TASKS[name], f"{a.data}/{TASKS[name].source}"
        if not readers.exists(spark, folder):
            continue
        schema = schemas.PAIR if task.columns[1] else schemas.SENTENCE
        rows = _identified(spark.read.schema(f"{schema}, split string").json(folder))
        for share in map(float, a.fractions.split(",")):
            own = sampling.fraction(rows.filter(F.col("split") == task.train), a.seed, share, "example_id")
            own.write.mode("overwrite").parquet(f"{a.out}/{name}/frac={share}")
        rows.filter(F.col("split") == task.validation).write.mode("overwrite").parquet(f"{a.out}/{name}/validation")


def build_sample(spark: SparkSession, a: argparse.Namespace) -> None:
    sampling.shuffled_head(_identified(readers.pairs_csv(spark, a.pairs)), a.seed, N_SAMPLE, "example_id").write.mode("overwrite").parquet(f"{a.out}/sample")


def _predictions(spark: SparkSession, a: argparse.Namespace, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(a.predictions).withColumn("pred", metrics.predicted())


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Metrics of each direction, model, seed and split; AUC by the difference of logits."""
    rows = _predictions(spark, a, schemas.PREDICTIONS).withColumn("margin", F.col("logit1") - F.col("logit0"))
    keys = ["direction", "model", "seed", "split"]
    found = metrics.evaluated(rows, *keys).join(metrics.auc(rows, "margin", *keys), keys)
    sinks.append_records(found, f"{a.out}/metrics", keys)


def _metric_of() -> dict[str, str]:
    return {name: t.metric for name, t in TASKS.items()}


def sentence(spark: SparkSession, a: argparse.Namespace) -> None:
    """Records of sentence tasks by model and seed, as the report reads them: the task's own metric, and the share of unknown
    tokens in the first validation texts, whose tokens(task, model, example_id, tokens) hold the special ones too."""
    rows = _predictions(spark, a, schemas.TASK_PREDICTIONS)
    keys = ["task", "model", "hf", "seed"]
    found = metrics.scored(rows, _metric_of(), *keys).drop("f1", "n")
    if a.tokens:
        tokens = spark.read.schema("task string, model string, example_id bigint, tokens array<string>").parquet(a.tokens)
        unknown = [tokenize.unknown_fraction(tokens.filter(F.array_contains("tokens", s[0])), "tokens", s[2], "example_id", "task", "model") for s in (tokenize.TEXT_SPECIALS, tokenize.RESIDUE_SPECIALS)]
        found = found.join(unknown[0].unionByName(unknown[1]), ["task", "model"], "left")
    sinks.append_records(found, f"{a.out}/esm_on_nl.jsonl", keys)


def crossmodal(spark: SparkSession, a: argparse.Namespace) -> None:
    """Records of the protein side of the 2 x 2 matrix: accuracy and F1 by model and seed."""
    keys = ["task", "model", "hf", "seed"]
    found = metrics.scored(_predictions(spark, a, schemas.TASK_PREDICTIONS), {}, *keys)
    sinks.append_records(found.drop("metric", "score", "n"), f"{a.out}/crossmodal_2x2.jsonl", keys)


def ablation(spark: SparkSession, a: argparse.Namespace) -> None:
    """Records of tasks by pretraining group, fraction, base and seed."""
    keys = ["task", "group", "frac", "base", "seed"]
    found = metrics.scored(_predictions(spark, a, schemas.GROUP_PREDICTIONS), _metric_of(), *keys)
    sinks.append_records(found.drop("acc", "f1", "n"), f"{a.out}/exp2_structural_nl.jsonl", keys)


#: The splits of a run that its record holds.
RUN_SPLITS = ("baseline_pawsx_test", "protein_indomain", "transfer_pawsx_test", "transfer_pawsx_val")


def transfer(spark: SparkSession, a: argparse.Namespace) -> None:
    """One record for each model and seed, with the metrics of all its splits."""
    each = metrics.evaluated(_predictions(spark, a, schemas.RUN_PREDICTIONS), "model", "seed", "split")
    values = F.struct(*(F.round(c, 4).alias(c) for c in ("acc_raw", "acc_flipbest", "f1")))
    found = each.groupBy("model", "seed").agg(*(F.max(F.when(F.col("split") == s, values)).alias(s) for s in RUN_SPLITS))
    sinks.append_records(found, f"{a.out}/tier1_distribution.jsonl", ["model", "seed"])


def dynamics(spark: SparkSession, a: argparse.Namespace) -> None:
    """A trajectory for each direction and seed, a point every eval_every steps."""
    rows = _predictions(spark, a, schemas.TRAINING_STEPS).filter(F.col("step") % a.eval_every == 0)
    each = metrics.evaluated(rows, "direction", "seed", "step")
    point = F.struct("step", F.round("acc_flipbest", 4).alias("transfer_flip"))
    sinks.append_records(each.groupBy("direction", "seed").agg(F.sort_array(F.collect_list(point)).alias("trajectory")), f"{a.out}/dynamics", ["direction", "seed"])


def _states(spark: SparkSession, a: argparse.Namespace, modality: str) -> DataFrame:
    """The first n examples of a modality in hash order, numbered by place: rows of two modalities meet by it."""
    rows = spark.read.schema(schemas.HIDDEN_STATES).parquet(a.states).filter(F.col("modality") == modality)
    places = sampling.shuffled_rank(rows.select("example_id").distinct(), a.seed, "example_id", name="row").filter(F.col("row") <= a.n)
    return rows.join(places, "example_id").select("model", "layer", "row", "features")


def cka(spark: SparkSession, a: argparse.Namespace) -> None:
    sides = [_states(spark, a, m) for m in a.modalities.split(",")]
    found = represent.layer_similarity(*sides, a.seed)
    values = F.struct(F.round("cka", 4).alias("cka"), F.round("cka_shuffled", 4).alias("cka_shuffled"))
    layers = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("layer").cast("string"), values))))
    sinks.append_records(found.groupBy("model").agg(layers.alias("per_layer")), f"{a.out}/cka", ["model"])


def _selected(spark: SparkSession, a: argparse.Namespace, last_query: bool, guard: str, homologs: str) -> DataFrame:
    """Selectivity of heads over the first n pairs of each modality in hash order. homologs: the condition under which only
    pairs labelled 1 count; pairs without a label count. What the guard says of L is about the weights' own length."""
    pairs = spark.read.schema(schemas.TOKEN_PAIRS).parquet(a.token_pairs).filter(f"not ({homologs}) or coalesce(label, 1) = 1")
    pairs = sampling.shuffled_rank(pairs, a.seed, "pair_id", by=["modality"]).filter(F.col("rank") <= a.n)
    diff = represent.usable_pairs(pairs) if guard == "min" else pairs.select("pair_id", "modality", diff_positions(F.col("a"), F.col("b")).alias("diff"))
    attention = spark.read.schema(schemas.ATTENTION).parquet(a.attention)
    return represent.selectivity(represent.rows_of_weights(attention), diff, last_query, guard)


def _top_heads(found: DataFrame) -> DataFrame:
    top = stats.top_within(found, "score", ["layer", "head"], ["model", "modality"])
    return top.join(found.groupBy("model", "modality").agg(F.max("n_pairs").alias("n_pairs"), F.max("score").alias("max_diff_attn"), F.avg("score").alias("mean_diff_attn")), ["model", "modality"])


def heads(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.append_records(_top_heads(_selected(spark, a, True, "min", "false")), f"{a.out}/heads", ["model", "modality"])


def forward_heads(spark: SparkSession, a: argparse.Namespace) -> None:
    """The same over homologous pairs only; a pair is left out where all of its places differ."""
    sinks.append_records(_top_heads(_selected(spark, a, True, "L", "true")), f"{a.out}/forward_heads", ["model", "modality"])


def selectivity(spark: SparkSession, a: argparse.Namespace) -> None:
    found = stats.z_of_max(_selected(spark, a, False, "L-1", "modality <> 'NL'"), "score", ["layer", "head"], "model", "modality")
    sinks.append_records(found.select("model", "modality", F.round("max", 4).alias("max"), F.round("z", 2).alias("z_of_max"), F.round("mean", 5).alias("mean_over_heads"), F.array("at_layer", "at_head").alias("max_head")), f"{a.out}/selectivity", ["model", "modality"])


def probe(spark: SparkSession, a: argparse.Namespace) -> None:
    """Cross-validated accuracy of all models' layers, fitted together; labels come as a table (example_id, label)."""
    states = spark.read.schema(schemas.HIDDEN_STATES).parquet(a.states)
    rows = states.join(spark.read.schema("example_id bigint, label int").parquet(a.labels), "example_id")
    rows = rows.join(sampling.shuffled_rank(rows.select("example_id").distinct(), a.seed, "example_id").filter(F.col("rank") <= a.n), "example_id")
    found = represent.probe_accuracy(rows, "features", "label", a.seed, "example_id", keys=("model", "layer"))
    each = found.groupBy(F.col("model").alias("base"), "layer").agg(F.round(F.avg("accuracy"), 4).alias("accuracy"))
    layers = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("layer").cast("string"), "accuracy"))))
    best = F.max(F.struct("accuracy", -F.col("layer")))
    out = each.groupBy("base").agg(layers.alias("per_layer"), F.max_by("accuracy", "layer").alias("probe_acc_last"), best.alias("best"))
    sinks.append_records(out.select("base", F.lit(a.seed).alias("seed"), (-F.col("best.col2")).alias("best_layer"), "probe_acc_last", F.col("best.accuracy").alias("probe_acc_best"), "per_layer"), f"{a.out}/probe", ["base", "seed"])


def build_report(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.write_summary(reports.summary(spark, a.records, a.mechanism), a.out)


#: What each command runs, and what it reads besides the experiments' settings.
COMMANDS = {
    "corpus": (build_corpora, ("fasta", "texts")),
    "dyck": (build_dyck, ()),
    "longrange": (build_longrange, ()),
    "pretraining": (build_blocks, ("corpus",)),
    "pilot": (build_splits, ("pairs",)),
    "distribution": (build_splits, ("pairs",)),
    "backbone": (build_splits, ("pairs",)),
    "bidirectional": (build_splits, ("pairs",)),
    "remote": (build_mixture, ("pairs", "remote_pairs")),
    "structural": (build_fractions, ("data",)),
    "forward": (build_sample, ("pairs",)),
    "evaluate": (evaluate, ("predictions",)),
    "sentence": (sentence, ("predictions", "tokens")),
    "crossmodal": (crossmodal, ("predictions",)),
    "ablation": (ablation, ("predictions",)),
    "transfer": (transfer, ("predictions",)),
    "dynamics": (dynamics, ("predictions",)),
    "cka": (cka, ("states",)),
    "probe": (probe, ("states", "labels")),
    "heads": (heads, ("attention", "token_pairs")),
    "forward_heads": (forward_heads, ("attention", "token_pairs")),
    "selectivity": (selectivity, ("attention", "token_pairs")),
    "report": (build_report, ("records", "mechanism")),
}
_MORE = {"seed": 0, "n_test": N_TEST, "tokenizer": "words", "modalities": "NL,protein"}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandlab", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (run, inputs) in COMMANDS.items():
        own = commands.add_parser(name)
        own.set_defaults(run=run)
        own.add_argument("--out", required=True)
        for option, value in (_MORE | DEFAULTS.get(name, {})).items():
            own.add_argument(f"--{option}", type=type(value), default=value)
        for option in inputs:
            own.add_argument(f"--{option}")
    parsed = parser.parse_args(args)
    spark = session()
    parsed.run(spark, parsed)
    if parsed.command != "report":
        settings = json.dumps({k: v for k, v in vars(parsed).items() if k != "run"}, sort_keys=True)
        sinks.overwrite_document(spark.sql("select 1").select(F.from_json(F.lit(settings), F.schema_of_json(F.lit(settings))).alias("s")).select("s.*"), f"{parsed.out}/settings_{parsed.command}")


if __name__ == "__main__":
    main()
