"""Report queries over run records: typed tables first, and a text summary of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlab.functions.scalars import fixed, signed
from strandlab.operators import stats
from strandlab.sources.readers import records

#: Models of the reports, with their families and sizes in millions of parameters.
MODELS = (
    ("esm2_8M", "esm", 8),
    ("esm2_35M", "esm", 35),
    ("esm2_150M", "esm", 150),
    ("esm2_650M", "esm", 650),
    ("protbert", "protbert", 420),
    ("bert_tiny", "bert", 4),
    ("bert_small", "bert", 11),
    ("bert_base", "bert", 110),
)
#: Rows of the cross-modal matrix with what they were pretrained on, fractions and groups of the ablation.
MATRIX = (("esm2_8M", "protein"), ("bert_small", "English"), ("bert_tiny", "English"))
FRACTIONS = (0.05, 0.1, 1.0)
GROUPS = ("base", "text", "protein", "shuffled")


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODELS), "model string, family string, params int")


def symmetry(rows: DataFrame) -> DataFrame:
    """T1: direction, mean, std and n of the flip-best transfer accuracy."""
    return stats.summarised(rows.select("direction", F.col("transfer.acc_flipbest").alias("v")), "v", "direction")


def reverse_distribution(rows: DataFrame) -> DataFrame:
    """T2: means and deviations over seeds, and how many beat their own baseline by more than 0.05."""
    v = {"transfer": "transfer_pawsx_test.acc_flipbest", "baseline": "baseline_pawsx_test.acc_flipbest", "indomain": "protein_indomain.acc_raw"}
    out = [f(c).alias(f"{n}_{s}") for n, c in v.items() for s, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return rows.agg(F.count("*").alias("n"), *out, F.count_if(F.col(v["transfer"]) - F.col(v["baseline"]) > 0.05).alias("above"))


def ablation(rows: DataFrame, task: str = "paws-x") -> DataFrame:
    """T3: frac, the groups' means, and protein less shuffled and less text."""
    own = rows.filter((F.col("task") == task) & F.col("frac").isin(*FRACTIONS))
    return stats.contrasted(own, "frac", "group", list(GROUPS), "score", {"structure": ("protein", "shuffled"), "biology": ("protein", "text")})


def crossmodal(sentence_rows: DataFrame, protein_rows: DataFrame, task: str = "paws-x") -> DataFrame:
    """T4: each backbone's mean on both sides; a side without runs is null."""
    dim = sentence_rows.sparkSession.createDataFrame(list(MATRIX), "model string, pretrain string")
    nl = sentence_rows.filter(F.col("task") == task).groupBy("model").agg(F.avg("score").alias("language"))
    bio = protein_rows.groupBy("model").agg(F.avg("acc").alias("protein"))
    return dim.join(bio, "model", "left").join(nl, "model", "left")


def off_domain_drop(matrix: DataFrame, language_model: str = "bert_small", protein_model: str = "esm2_8M") -> DataFrame:
    of = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    return matrix.agg((of(language_model, "language") - of(language_model, "protein")).alias("language_drop"), (of(protein_model, "protein") - of(protein_model, "language")).alias("protein_drop"))


def scaling(rows: DataFrame, task: str = "paws-x") -> DataFrame:
    """T5 and the points of figure 3: family, model, params, mean, std and n, for models with runs."""
    own = stats.summarised(rows.filter(F.col("task") == task), "score", "model")
    return own.join(F.broadcast(models(rows.sparkSession)), "model").select("family", "model", "params", "mean", "std", "n")


def scaling_ladders(rows: DataFrame, task: str = "paws-x") -> DataFrame:
    """scaling, with each model's place in its family by size: the order of figure 3."""
    order = Window.partitionBy("family").orderBy("params")
    return scaling(rows, task).withColumn("place", F.row_number().over(order))


def sentence_tasks(rows: DataFrame, names: tuple[str, ...] = ("esm2_8M", "bert_small")) -> DataFrame:
    """T6: task and the models' mean scores."""
    return rows.groupBy("task").pivot("model", list(names)).agg(F.avg("score"))


def bracket_results(rows: DataFrame, frac: float = 1.0) -> DataFrame:
    """T7: base, task and the groups' means on bracket tasks; records without a base are of gpt2."""
    own = rows.filter(F.contains("task", F.lit("dyck")) & (F.col("frac") == frac)).withColumn("base", F.coalesce("base", F.lit("gpt2")))
    wide = own.groupBy("base", "task").pivot("group", ["protein", "shuffled", "text"]).agg(F.avg("score"))
    return wide.withColumn("structure", F.col("protein") - F.col("shuffled"))


def dynamics_ends(rows: DataFrame) -> DataFrame:
    """T8: mean first and last value of the trajectories."""
    return rows.groupBy("direction").agg(F.avg(F.element_at("trajectory", 1)["transfer_flip"]).alias("start"), F.avg(F.element_at("trajectory", -1)["transfer_flip"]).alias("end"))


def selectivity_heads(rows: DataFrame) -> DataFrame:
    """T8: model, modality, the largest selectivity, its z-score and its head, as recorded."""
    head = F.concat(F.lit("L"), F.col("max_head")[0], F.lit("H"), F.col("max_head")[1])
    return rows.select("model", "modality", "max", F.col("z_of_max").alias("z"), head.alias("head"))


def dynamics_curve(rows: DataFrame) -> DataFrame:
    """Points of figure 2."""
    return stats.curve(rows)


def best_layers(rows: DataFrame) -> DataFrame:
    """Per model the layer of the largest CKA, the first of equals, by number and not by text."""
    each = rows.select("model", F.explode("per_layer").alias("layer", "v")).withColumn("layer", F.col("layer").cast("int"))
    top = F.max(F.struct(F.col("v.cka"), -F.col("layer"), F.col("v.cka_shuffled").alias("floor")))
    return each.groupBy("model").agg(top.alias("m")).select("model", (-F.col("m.col2")).alias("layer"), "m.cka", "m.floor")


def last_layer_probe(rows: DataFrame) -> DataFrame:
    """Per group the mean of the last layer's probe accuracy, and how often it agrees with the recorded one."""
    keys = F.array_max(F.transform(F.map_keys("per_layer"), lambda k: k.cast("int")))
    each = rows.withColumn("last", F.element_at("per_layer", keys.cast("string")))
    return each.groupBy("group").agg(F.avg("last").alias("mean"), F.count_if(F.abs(F.col("last") - F.col("probe_acc_last")) < 1e-9).alias("agree"), F.count("*").alias("n"))


def distribution(rows: DataFrame, metric: str = "acc_flipbest", base: str = "baseline_pawsx_test", transfer: str = "transfer_pawsx_test") -> DataFrame:
    """T9: statistics of transfer, baseline and their paired difference, long."""
    each = rows.select("seed", F.col(f"{transfer}.{metric}").alias("transfer"), F.col(f"{base}.{metric}").alias("baseline"))
    each = each.withColumn("difference", F.col("transfer") - F.col("baseline"))
    long = each.unpivot(["seed"], ["transfer", "baseline", "difference"], "what", "v")
    return stats.described(long, "v", "what")


def top_seeds(rows: DataFrame, metric: str = "acc_flipbest", transfer: str = "transfer_pawsx_test", k: int = 5) -> DataFrame:
    own = {"transfer": f"{transfer}.{metric}", "baseline": f"baseline_pawsx_test.{metric}", "indomain": "protein_indomain.acc_raw"}
    return stats.top(rows.select("seed", *(F.col(c).alias(n) for n, c in own.items())), "transfer", "seed", k)


#: The files of records that a summary reads, with their kinds.
FILES = {
    "bidirectional_symmetry": "bidirectional",
    "tier1_distribution": "backbone",
    "exp2_structural_nl_gpt2_124M": "structural",
    "exp2_structural_nl": "structural",
    "esm_on_nl": "sentence_tasks",
    "crossmodal_2x2": "crossmodal",
    "M2_learning_dynamics": "dynamics",
    "M3c_rigorous": "selectivity",
}


def summary(spark: SparkSession, folder: str, mechanism: str | None = None) -> DataFrame:
    """(line_no, text): headings and formatted rows of T1 to T9, as far as their records are there.

    mechanism: the folder of the records of T8, if it is another one. Records of a run are few (thousands at most): each
    table is a few rows, which are numbered in order.
    """
    parts = []
    load = lambda name: records(spark, f"{mechanism or folder}/{name}.jsonl" if name.startswith("M") else f"{folder}/{name}.jsonl", FILES[name])
    text = lambda *columns: F.concat_ws(" ", *columns)
    told = lambda label, column: F.concat(F.lit(f"{label}="), fixed(F.col(column)))
    spread = lambda mean="mean", std="std": F.concat(fixed(F.col(mean)), F.lit(" ± "), fixed(F.col(std)))

    def add(title: str, table: DataFrame, line) -> None:
        if table.isEmpty():
            return
        at = 1000 * len(parts)
        head = spark.createDataFrame([(at, title)], "line_no int, text string")
        parts.append(head.unionByName(table.select((F.lit(at) + F.row_number().over(Window.orderBy(*table.columns[:2]))).alias("line_no"), line.alias("text"))))

    add("Transfer by direction", symmetry(load("bidirectional_symmetry")), text("direction", spread(), F.concat(F.lit("n="), F.col("n"))))
    runs = load("tier1_distribution")
    reverse = reverse_distribution(runs).filter("n > 0")
    add("Reverse transfer over seeds", reverse, text(F.lit("indomain"), spread("indomain_mean", "indomain_std"), F.lit("transfer"), spread("transfer_mean", "transfer_std"), F.lit("baseline"), spread("baseline_mean", "baseline_std"), F.concat(F.lit("above="), F.col("above"), F.lit("/"), F.col("n"))))
    for size, rows in (("124M", load("exp2_structural_nl_gpt2_124M")), ("355M", load("exp2_structural_nl").filter("base = 'gpt2-medium'"))):
        add(f"Pretraining ablation {size}", ablation(rows), text(F.col("frac").cast("string"), *(told(g, g) for g in GROUPS), signed(F.col("structure")), signed(F.col("biology"))))
    sentences = load("esm_on_nl")
    matrix = crossmodal(sentences, load("crossmodal_2x2")).filter("protein is not null or language is not null")
    add("Cross-modal matrix", matrix, text("model", "pretrain", fixed(F.col("protein")), fixed(F.col("language"))))
    add("Off-domain drop", off_domain_drop(matrix).filter("language_drop is not null and protein_drop is not null"), text(F.lit("language"), signed(F.col("language_drop")), F.lit("protein"), signed(F.col("protein_drop"))))
    add("Scaling", scaling_ladders(sentences).select("family", "params", "model", "mean", "std"), text("family", "model", F.concat(F.col("params"), F.lit("M")), spread()))
    add("Sentence tasks", sentence_tasks(sentences), text("task", told("esm2_8M", "esm2_8M"), told("bert_small", "bert_small")))
    add("Bracket tasks", bracket_results(load("exp2_structural_nl")), text("base", "task", told("protein", "protein"), told("shuffled", "shuffled"), told("text", "text"), signed(F.col("structure"))))
    add("Learning dynamics", dynamics_ends(load("M2_learning_dynamics")), text("direction", fixed(F.col("start")), F.lit("->"), fixed(F.col("end"))))
    add("Selectivity of heads", selectivity_heads(load("M3c_rigorous")), text("model", "modality", F.concat(F.lit("max="), F.col("max")), F.concat(F.lit("z="), F.col("z")), "head"))
    if not runs.isEmpty():
        add("Distribution of transfer", distribution(runs), text("what", *(told(c, c) for c in ("mean", "std", "min", "p25", "median", "p75", "max"))))
        add("Best seeds", top_seeds(runs).select(-F.col("transfer"), "seed", "transfer", "baseline"), text(F.col("seed").cast("string"), fixed(F.col("transfer")), fixed(F.col("baseline"))))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "line_no int, text string")
