"""Each operator as a query over the driver's tables, with the SQL that must give the same rows.

Driver tables stand in for inputs that aren't shipped: labels.quality is a label, text length a score, source and lang
are groups, events are runs. They exercise semantics; the values mean nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.functions import scalars
from strandlab.operators import corpus, metrics, represent, sampling, sequences, stats, tasks
from strandlab.plans import reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as predictions: example_id, lang, source, label, score and pred."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").alias("score"))
    rows = _t(spark, sf_dir, "labels").join(docs, "doc_id")
    rows = rows.withColumns({"logit0": F.lit(1000.0), "logit1": F.col("score").cast("double")}).withColumn("pred", metrics.predicted())
    return rows.select(F.col("doc_id").alias("example_id"), "lang", "source", F.col("quality").alias("label"), "score", "pred")


_P = "p as (select l.doc_id as example_id, d.lang, d.source, l.quality as label, d.n_chars as score, (d.n_chars > 1000)::int as pred from labels l join documents d on l.doc_id = d.doc_id)"
_C = "count(*) filter (where label = 0 and pred = 0) as tn, count(*) filter (where label = 0 and pred = 1) as fp, count(*) filter (where label = 1 and pred = 0) as fn, count(*) filter (where label = 1 and pred = 1) as tp"


@query("select event_type, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, count(value) as n from events group by event_type")
def metric_summary(spark, sf_dir):
    out = stats.summarised(_t(spark, sf_dir, "events"), "value", "event_type")
    return out.select("event_type", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query(f"""with {_P}, c as (select lang, count(*) as n, {_C} from p group by lang)
select lang, n, round((tn + tp) / n, 6) as acc_raw, round(greatest((tn + tp) / n, 1 - (tn + tp) / n), 6) as acc_flipbest,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1, tn, fp, fn, tp from c""")
def binary_metrics(spark, sf_dir):
    out = metrics.evaluated(_scored(spark, sf_dir), "lang")
    cells = {n: F.col("confusion")[a][b] for n, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))}
    return out.select("lang", "n", *(F.round(c, 6).alias(c) for c in ("acc_raw", "acc_flipbest", "f1")), *(c.alias(n) for n, c in cells.items()))


@query(f"""with {_P}, c as (select source, {_C} from p group by source)
select source, round(coalesce((tp::double * tn - fp::double * fn) / nullif(sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) + 0.0 as mcc from c""")
def mcc_by_group(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("source").agg((F.round(metrics.mcc(), 6) + 0.0).alias("mcc"))


@query(f"""with {_P}, c as (select source, count(*) as n, {_C} from p group by source),
g as (select *, (tn + tp) / n < 0.5 as label_flipped from c),
f as (select source, n, label_flipped, case when label_flipped then fp else tn end as tn, case when label_flipped then tn else fp end as fp,
  case when label_flipped then tp else fn end as fn, case when label_flipped then fn else tp end as tp from g)
select *, round((tn + tp) / n, 6) as accuracy, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from f""")
def pilot_flip_guard(spark, sf_dir):
    out = metrics.guarded(_scored(spark, sf_dir), "source")
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "f1")})


@query(f"""with {_P}, r as (select lang, label, rank() over (partition by lang order by score) + (count(*) over (partition by lang, score) - 1) / 2.0 as r from p),
a as (select lang, sum(r) filter (where label = 1) as s, count(*) filter (where label = 1) as n1, count(*) filter (where label = 0) as n0 from r group by lang)
select lang, round((s - n1 * (n1 + 1) / 2.0) / nullif(n1 * n0, 0)::double, 6) as auc, round(greatest((s - n1 * (n1 + 1) / 2.0) / nullif(n1 * n0, 0)::double, 1 - (s - n1 * (n1 + 1) / 2.0) / nullif(n1 * n0, 0)::double), 6) as auc_flipbest from a""")
def auc_midrank(spark, sf_dir):
    out = metrics.auc(_scored(spark, sf_dir), "score", "lang")
    return out.select("lang", F.round("auc", 6).alias("auc"), F.round("auc_flipbest", 6).alias("auc_flipbest"))


@query("""select event_type, count(value) as n, round(avg(value), 4) as mean, round(stddev_pop(value), 4) as std, round(min(value), 4) as min, round(quantile_cont(value, 0.25), 4) as p25,
  round(quantile_cont(value, 0.5), 4) as median, round(quantile_cont(value, 0.75), 4) as p75, round(max(value), 4) as max from events group by event_type""")
def distribution_stats(spark, sf_dir):
    return stats.described(_t(spark, sf_dir, "events"), "value", "event_type")


def _paired(spark, sf_dir):
    """Each user as a run: the mean of views as transfer, of clicks as baseline."""
    mean = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    out = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.round(mean("view"), 6).alias("transfer"), F.round(mean("click"), 6).alias("baseline"))
    return out.filter("transfer is not null and baseline is not null").withColumn("difference", F.round(F.col("transfer") - F.col("baseline"), 6))


_D = "d as (select user_id, round(avg(value) filter (where event_type = 'view'), 6) as transfer, round(avg(value) filter (where event_type = 'click'), 6) as baseline from events group by user_id), e as (select *, round(transfer - baseline, 6) as difference from d where transfer is not null and baseline is not null)"


@query(f"with {_D} select count(*) as n, count(*) filter (where difference > 0) as above_0, count(*) filter (where difference > 0.02) as above_1, count(*) filter (where difference > 0.05) as above_2 from e")
def paired_diff_tail(spark, sf_dir):
    return stats.exceeding(_paired(spark, sf_dir), F.col("difference"))


@query(f"""with {_D}, r as (select row_number() over (order by user_id) as place, difference from e), k as (select count(*) as n from r),
i as (select b, n, unnest(range(n)) as i from k, range(5000) x(b)),
m as (select b, avg(difference) as m from (select b, ('0x' || substr(md5('7:' || b || ':' || i // 4), 1 + 8 * (i % 4), 8))::bigint % n + 1 as place from i) t join r using (place) group by b)
select round(quantile_cont(m, 0.025), 4) as low, round(quantile_cont(m, 0.975), 4) as high, count(*) as draws from m""")
def bootstrap_ci(spark, sf_dir):
    runs = sampling.placed(_paired(spark, sf_dir), "user_id")
    out = stats.bootstrap_mean(runs, "place", "difference", seed=7)
    return out.select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "draws")


@query(f"""with {_P} select source, round(avg(label) filter (where lang = 'en'), 6) as en, round(avg(label) filter (where lang = 'de'), 6) as de, round(avg(label) filter (where lang = 'fr'), 6) as fr,
  round(avg(label) filter (where lang = 'en') - avg(label) filter (where lang = 'de'), 6) + 0.0 as en_de, round(avg(label) filter (where lang = 'en') - avg(label) filter (where lang = 'fr'), 6) + 0.0 as en_fr from p group by source""")
def pivot_contrast(spark, sf_dir):
    out = stats.contrasted(_scored(spark, sf_dir), "source", "lang", ["en", "de", "fr"], "label", {"en_de": ("en", "de"), "en_fr": ("en", "fr")})
    return out.select("source", *(F.round(c, 6).alias(c) for c in ("en", "de", "fr")), *((F.round(c, 6) + 0.0).alias(c) for c in ("en_de", "en_fr")))


@query(f"""with {_P}, dim(model, family) as (values ('src0', 'a'), ('src1', 'a'), ('src2', 'b'), ('none', 'b')),
x as (select source, avg(label) as v from p where lang = 'en' group by source), y as (select source, avg(pred) as v from p group by source)
select model, family, round(x.v, 6) as language, round(y.v, 6) as protein, round(x.v - y.v, 6) + 0.0 as dropped from dim left join x on x.source = model left join y on y.source = model""")
def matrix_2x2(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    dim = spark.createDataFrame([("src0", "a"), ("src1", "a"), ("src2", "b"), ("none", "b")], "model string, family string")
    x = rows.filter("lang = 'en'").groupBy(F.col("source").alias("model")).agg(F.avg("label").alias("x"))
    y = rows.groupBy(F.col("source").alias("model")).agg(F.avg("pred").alias("y"))
    out = dim.join(x, "model", "left").join(y, "model", "left")
    return out.select("model", "family", F.round("x", 6).alias("language"), F.round("y", 6).alias("protein"), (F.round(F.col("x") - F.col("y"), 6) + 0.0).alias("dropped"))


@query("select user_id, round(avg(value), 6) as mean from events group by user_id order by mean desc, user_id limit 5")
def top_runs(spark, sf_dir):
    runs = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"))
    return stats.top(runs, "mean", "user_id")


@query("""with m as (select event_type, user_id, round(avg(value), 6) as v from events group by all),
r as (select *, row_number() over (partition by event_type order by v desc, user_id) as r from m)
select event_type, 6 - r as place, user_id, v from r where r <= 5""")
def top_within(spark, sf_dir):
    runs = _t(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.round(F.avg("value"), 6).alias("v"))
    out = stats.top_within(runs, "v", ["user_id"], ["event_type"])
    # Of equal values the smaller user ranks higher, so places are counted again by that order.
    return out.select("event_type", F.posexplode(F.array_sort("top", lambda a, b: F.when(a["v"] < b["v"], -1).when(a["v"] > b["v"], 1).otherwise(F.signum(b["user_id"] - a["user_id"]).cast("int")))).alias("p", "x")).select("event_type", (F.col("p") + 1).cast("long").alias("place"), "x.user_id", "x.v")


def _trajectories(spark, sf_dir):
    """Runs: event types as directions, three seeds by user, a point for each day. Points are whole: sums of cents divided
    as integers, so no rounding stands between them and the curve."""
    e = _t(spark, sf_dir, "events")
    points = e.groupBy(F.col("event_type").alias("direction"), F.pmod("user_id", F.lit(3)).alias("seed"), F.dayofmonth("ts").alias("step")).agg(F.expr("cast(sum(cast(round(value * 100) as bigint)) div count(value) as double)").alias("transfer_flip"))
    return points.groupBy("direction", "seed").agg(F.sort_array(F.collect_list(F.struct("step", "transfer_flip"))).alias("trajectory"))


_R = "t as (select event_type as direction, user_id % 3 as seed, day(ts)::int as step, (sum(round(value * 100)::bigint)::bigint // count(value))::double as v from events group by all), q as (select *, row_number() over (partition by direction, seed order by step) - 1 as pos, count(*) over (partition by direction, seed) as len from t)"


@query(f"with {_R} select direction, round(avg(v) filter (where pos = 0), 6) as start, round(avg(v) filter (where pos = len - 1), 6) as end from q group by direction")
def trajectory_ends(spark, sf_dir):
    out = reports.dynamics_ends(_trajectories(spark, sf_dir))
    return out.select("direction", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(f"with {_R}, m as (select direction, min(len) as m from q group by direction) select direction, step, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std, count(*) as n from q join m using (direction) where pos < m group by direction, step")
def trajectory_curve(spark, sf_dir):
    out = stats.curve(_trajectories(spark, sf_dir))
    return out.select("direction", "step", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("select event_type, day(ts)::int as step, count(*) as n from events where day(ts) % 6 = 0 or day(ts) = 1 group by all")
def sampled_steps(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").withColumn("step", F.dayofmonth("ts")).filter("step % 6 = 0 or step = 1")
    return rows.groupBy("event_type", "step").agg(F.count("*").alias("n"))


@query("""with x as (select label, i - 1 as head, e[i]::double as v from (select label, embedding as e, unnest(range(1, len(embedding) + 1)) as i from embeddings)),
s as (select label, head // 8 as layer, head % 8 as head, round(avg(v), 6) as score from x group by all)
select label, max(score) as max, arg_max(layer, score * 1e9 - layer * 8 - head) as at_layer, arg_max(head, score * 1e9 - layer * 8 - head) as at_head,
  round(avg(score), 6) + 0.0 as mean, round((max(score) - avg(score)) / (stddev_pop(score) + 1e-9), 4) as z from s group by label""")
def zscore_argmax(spark, sf_dir):
    each = _t(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    heads = each.groupBy("label", F.expr("i div 8").alias("layer"), (F.col("i") % 8).cast("long").alias("head")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("score"))
    out = stats.z_of_max(heads, "score", ["layer", "head"], "label")
    return out.withColumns({"mean": F.round("mean", 6) + 0.0, "z": F.round("z", 4)})


@query("""with t as (select doc_id, len(regexp_extract_all(text, '\\S+')) as n_tokens from documents),
r as (select *, coalesce(sum(n_tokens) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from t)
select doc_id, n_tokens::bigint as n_tokens from r where before < 50000""")
def token_cap(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.regexp_count("text", F.lit(r"\S+")).cast("long")
    return corpus.capped(docs, ["doc_id"], F.floor(F.col("doc_id") / 10_000), n, 50_000).select("doc_id", "n_tokens")


@query("with t as (select doc_id, replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') as text from documents) select doc_id, text from t where length(text) > 0")
def clean_text_corpus(spark, sf_dir):
    return corpus.clean(_t(spark, sf_dir, "documents")).select("doc_id", "text")


_L = "l as (select unnest(string_split(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '')) as c from documents), k as (select c, count(*) as n from l group by c), a as (select unnest(string_split('ACDEFGHIKLMNPQRSTVWY', '')) as residue), j as (select residue, coalesce(n, 1) as n from a left join k on c = residue)"


def _capitals(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select(F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("seq"))


@query(f"with {_L} select residue, n, round(n / sum(n) over (), 6) as p from j")
def residue_freq(spark, sf_dir):
    return sequences.frequencies(_capitals(spark, sf_dir)).withColumn("p", F.round("p", 6))


@query("select item_id, '<protein> ' || array_to_string(string_split(text, ''), ' ') || ' </protein>' as line from benchmark where text <> ''")
def render_chars(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").filter("text <> ''").select("item_id", scalars.protein_line(F.col("text")).alias("line"))


@query("""with c as (select item_id, unnest(string_split(text, '')) as c, unnest(range(length(text))) as i from benchmark)
select item_id, string_agg(c, '' order by md5('7:' || item_id || ':' || i)) as shuffled from c group by item_id""")
def residue_shuffle(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select("item_id", sequences.shuffled(F.col("text"), 7, F.col("item_id")).alias("shuffled"))


@query(f"""with {_L}, f as (select residue, n / sum(n) over () as p from j), g as (select residue, sum(p) over (order by residue) as until from f),
s as (select list(residue order by residue) as rs, list(until order by residue) as us from g),
c as (select item_id, unnest(range(length(text))) as i from benchmark),
u as (select item_id, i, ('0x' || substr(md5('7:' || item_id || ':' || i), 1, 8))::bigint / 4294967296.0::double as u from c)
select item_id, string_agg(rs[least(20, 1 + len(list_filter(us, lambda x: x <= u)))], '' order by i) as resampled from u, s group by item_id""")
def residue_resample(spark, sf_dir):
    """Letters drawn by the frequencies of all documents' letters."""
    steps = sequences.cumulative(sequences.frequencies(_capitals(spark, sf_dir)))
    return _t(spark, sf_dir, "benchmark").select("item_id", sequences.resampled(F.length("text"), 7, F.col("item_id"), steps).alias("resampled"))


@query("""with r as (select doc_id, row_number() over (order by md5('7:' || doc_id), doc_id) as r from documents)
select doc_id, case when r <= 200 then 'test' else 'train' end as split from r""")
def hash_split(spark, sf_dir):
    return sampling.split(_t(spark, sf_dir, "documents").select("doc_id"), 7, 200, "doc_id")


@query(f"with {_P}, r as (select example_id, label, row_number() over (partition by label order by md5('7:' || example_id), example_id) as r from p) select example_id, label from r where r <= 20")
def balanced_sample(spark, sf_dir):
    return sampling.balanced(_scored(spark, sf_dir), 7, 40, "example_id").select("example_id", "label")


@query(f"""with {_P}, a as (select example_id, label, row_number() over (partition by label order by md5('7:' || example_id), example_id) as r from p where lang = 'en'),
b as (select example_id, label, row_number() over (partition by label order by md5('8:' || example_id), example_id) as r from p where lang <> 'en'),
m as (select example_id, label, 'remote' as part from a where r <= 14 union all select example_id, label, 'standard' from b where r <= 6)
select *, row_number() over (order by md5('7:' || part || ':' || example_id), part, example_id) as place from m""")
def mixture_sample(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    out = sampling.placed_mixture(rows.filter("lang = 'en'"), rows.filter("lang <> 'en'"), 7, 40, 0.7, "example_id")
    return out.select("example_id", "label", "part", "place")


@query(f"with {_P}, r as (select example_id, row_number() over (order by md5('7:' || example_id), example_id) as r, count(*) over () as n from p) select example_id from r where r <= greatest(64, floor(n * 0.1))")
def fraction_subsample(spark, sf_dir):
    return sampling.fraction(_scored(spark, sf_dir), 7, 0.1, "example_id").select("example_id")


@query(f"with {_P} select example_id, label from p order by md5('3:' || example_id), example_id limit 100")
def fixed_sample(spark, sf_dir):
    return sampling.shuffled_head(_scored(spark, sf_dir), 3, 100, "example_id").select("example_id", "label")


@query("""with t as (select doc_id, doc_id // 100 as batch, regexp_extract_all(text, '\\S+') as w from documents),
e as (select batch, doc_id, unnest(w) as t, unnest(range(len(w))) as i from t), p as (select batch, t, row_number() over (partition by batch order by doc_id, i) - 1 as p from e),
b as (select batch, p // 512 as block, count(*) as n, md5(string_agg(t, ' ' order by p)) as digest from p group by all)
select batch, block, digest from b where n = 512""")
def block_pack(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("w"))
    out = corpus.packed(docs, F.expr("doc_id div 100"), ["doc_id"], "w", 512)
    return out.select("batch", "block", F.md5(F.array_join("block_tokens", " ")).alias("digest"))


@query("""with t as (select item_id, regexp_extract_all(text, '\\S+')[1:24] as w from benchmark)
select item_id, array_to_string(w, ' ') || repeat(' <pad>', greatest(0, 24 - len(w))::bigint) as tokens, len(w)::int as n_true from t""")
def truncate_pad(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    ids, mask = corpus.padded(words, 24, F.lit("<pad>"))
    return _t(spark, sf_dir, "benchmark").select("item_id", F.array_join(ids, " ").alias("tokens"), F.size(F.filter(mask, lambda x: x == 1)).alias("n_true"))


@query("""with f as (select text from documents order by doc_id limit 200), e as (select unnest(regexp_extract_all(text, '\\S+')[1:256]) as t from f),
v as (select distinct unnest(regexp_extract_all(text, '\\S+')) as t from benchmark)
select round(count(*) filter (where v.t is null) / greatest(count(*), 1), 4) as unk_frac, count(*) as n_tokens from e left join v on e.t = v.t""")
def unk_fraction(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    docs = _t(spark, sf_dir, "documents").select("doc_id", words.alias("tokens"))
    vocabulary = _t(spark, sf_dir, "benchmark").select(F.explode(words).alias("token"))
    return corpus.unknown_share(docs, vocabulary, most_tokens=256, order="doc_id")


def _turn_pairs(spark, sf_dir):
    """Adjacent turns as pairs of token arrays."""
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("w"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("b"))
    return c.withColumnRenamed("w", "a").join(after, ["conv_id", "turn"])


_V = "c as (select conv_id, turn, regexp_extract_all(text, '\\S+') as w from conversations), v as (select x.conv_id, x.turn, x.w as a, y.w as b, least(len(x.w), len(y.w)) as n from c x join c y on x.conv_id = y.conv_id and y.turn = x.turn + 1), d as (select *, list_filter(range(n), lambda i: a[i + 1] <> b[i + 1]) as diff from v)"


@query(f"with {_V} select conv_id, turn, array_to_string(diff, ',') as diff from d")
def diff_positions(spark, sf_dir):
    return _turn_pairs(spark, sf_dir).select("conv_id", "turn", F.array_join(scalars.diff_positions(F.col("a"), F.col("b")).cast("array<string>"), ",").alias("diff"))


@query(f"""with {_V} select conv_id, turn, len(list_filter(range(n), lambda i: not list_contains(diff, i)))::int as n_matched, len(diff) > 0 and len(diff) < n as by_shorter,
  len(diff) > 0 and len(diff) < len(a) as by_length, len(diff) > 0 and len(diff) < len(a) - 1 as by_inner from d""")
def diff_skip_guard(spark, sf_dir):
    rows = _turn_pairs(spark, sf_dir).withColumn("diff", scalars.diff_positions(F.col("a"), F.col("b")))
    n, length = F.least(F.size("a"), F.size("b")), F.size("a")
    guard = lambda bound: scalars.usable_difference(F.col("diff"), bound)
    return rows.select("conv_id", "turn", F.size(scalars.matched_positions(F.col("diff"), n)).alias("n_matched"), guard(n).alias("by_shorter"), guard(length).alias("by_length"), guard(length - 1).alias("by_inner"))


#: Words of 40 brackets of three types: a step for each row of the recursion, by the draws of the operator.
_W = """w as (select p_partkey as id, 0 as i, '' as word, '' as stack from part
  union all select id, i + 1, word || t, case when close then stack[2:] else t || stack end from (
    select *, case when close then translate(stack[1], '([{', ')]}') else substr('([{', 1 + floor(v * 3)::int, 1) end as t from (
      select *, stack <> '' and (40 - i <= length(stack) or u < 0.5) as close from (
        select *, ('0x' || substr(h, 1, 8))::bigint / 4294967296.0::double as u, ('0x' || substr(h, 9, 8))::bigint / 4294967296.0::double as v from (
          select *, md5('0:' || id || ':step:' || i) as h from w where i < 40))))),
g as (select id, word from w where i = 40)"""


@query(f"with recursive {_W} select id, array_to_string(string_split(word, ''), ' ') as sentence from g")
def dyck_generate(spark, sf_dir):
    ids = tasks.spread(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))
    return ids.select("id", F.array_join(tasks.bracket_word(F.col("id"), 40, 3, 0), " ").alias("sentence"))


def _drawn(*parts: str) -> str:
    return "(('0x' || substr(md5(" + " || ':' || ".join(["'0'", "id", *parts]) + "), 1, 8))::bigint / 4294967296.0::double)"


@query(f"""with recursive {_W},
c as (select id, word, ({_drawn("'label'")} < 0.5)::int as label, floor({_drawn("'swap'")} * 40)::int as i, floor({_drawn("'other'")} * 39)::int as d from g),
a as (select *, list_transform(range(10), lambda k: word[1:floor({_drawn("'place'", "k")} * 40)::int] || substr('()[]{{}}', 1 + floor({_drawn("'token'", "k")} * 6)::int, 1) || word[floor({_drawn("'place'", "k")} * 40)::int + 2:]) as tries from c),
b as (select *, list_filter(tries, lambda w: list_reduce(list_concat([w], range(20)::varchar[]), lambda x, y: replace(replace(replace(x, '()', ''), '[]', ''), '{{}}', '')) <> '') as broken, (i + 1 + d) % 40 as j from a),
s as (select *, list_transform(range(40), lambda p: case when p = i then word[j + 1] when p = j then word[i + 1] else word[p + 1] end) as swapped from b)
select id, array_to_string(string_split(case when label = 1 then word when len(broken) > 0 then broken[1] else array_to_string(swapped, '') end, ''), ' ') as sentence, label from s""")
def dyck_corrupt(spark, sf_dir):
    return tasks.bracket_task(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))


@query("""with recursive w as (select p_partkey as id, list_transform(range(6), lambda i: substr('()[]{}', 1 + (('0x' || substr(md5('5:' || p_partkey || ':' || i), 1, 8))::bigint % 6)::int, 1)) as w from part),
s as (select id, array_to_string(w, '') as text, array_to_string(w, '') as rest, 0 as step from w
  union all select id, text, replace(replace(replace(rest, '()', ''), '[]', ''), '{}', ''), step + 1 from s where step < 4)
select id, text, rest = '' as ok from s where step = 4""")
def dyck_validate(spark, sf_dir):
    draw = lambda i: stats.hash_index(5, F.lit(6), F.col("p_partkey"), i).cast("int")
    word = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.substring(F.lit("()[]{}"), draw(i) + 1, F.lit(1)))
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), word.alias("w"))
    return rows.select("id", F.array_join("w", "").alias("text"), scalars.well_formed(F.col("w"), 3).alias("ok"))


def _u(*parts: str) -> str:
    return "(('0x' || substr(md5(" + " || ':' || ".join(["'0'", "id", *parts]) + "), 1, 8))::bigint / 4294967296.0::double)"


def _pick(values: tuple[str, ...], u: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][1 + floor({u} * {len(values)})::int]"


@query(f"""with i as (select p_partkey as id from part), g as (select id, {_u("'number'")} < 0.5 as sg, ({_u("'label'")} < 0.5)::int as label from i),
c as (select g.*, list_transform(range(1, 4), lambda k: {_pick(tasks.PREPS, _u("'prep'", "k"))} || ' the ' || {_pick(tasks.ADJS, _u("'adj'", "k"))} || ' ' ||
  case when sg then {_pick(tasks.PL_NOUNS, _u("'noun'", "k"))} else {_pick(tasks.SG_NOUNS, _u("'noun'", "k"))} end) as d from g)
select id, 'The ' || case when sg then {_pick(tasks.SG_NOUNS, _u("'head'"))} else {_pick(tasks.PL_NOUNS, _u("'head'"))} end || ' ' || array_to_string(d, ' ') || ' ' ||
  case when sg = (label = 1) then {_pick(tasks.SG_VERBS, _u("'verb'"))} else {_pick(tasks.PL_VERBS, _u("'verb'"))} end || ' .' as sentence, label from c""")
def longrange_generate(spark, sf_dir):
    return tasks.agreement_task(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")))


def _halves(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row"), F.slice("embedding", 1, 32).alias("features")), e.select(F.col("vec_id").alias("row"), F.slice("embedding", 33, 32).alias("features"))


def _cka_sql(right: str) -> str:
    return f"""with e as (select vec_id, embedding as e from embeddings), {right},
b as (select x.e[1:32] as x, y.e[33:64] as y from e x join r on x.vec_id = r.vec_id join e y on y.vec_id = r.other),
n as (select row_number() over () as k, x, y from b),
xs as (select k, unnest(x)::double as v, unnest(range(32)) as i from n), ys as (select k, unnest(y)::double as v, unnest(range(32)) as i from n),
xc as (select k, i, v - avg(v) over (partition by i) as v from xs), yc as (select k, i, v - avg(v) over (partition by i) as v from ys),
xy as (select sum(g * g) as s from (select sum(a.v * b.v) as g from xc a join yc b using (k) group by a.i, b.i)),
xx as (select sum(g * g) as s from (select sum(a.v * b.v) as g from xc a join xc b using (k) group by a.i, b.i)),
yy as (select sum(g * g) as s from (select sum(a.v * b.v) as g from yc a join yc b using (k) group by a.i, b.i))
select round(xy.s / (sqrt(xx.s) * sqrt(yy.s) + 1e-12), 6) as cka from xy, xx, yy"""


@query(_cka_sql("r as (select vec_id, vec_id as other from embeddings)"))
def linear_cka(spark, sf_dir):
    return represent.linear_cka(*_halves(spark, sf_dir)).select(F.round("cka", 6).alias("cka"))


@query(_cka_sql("a as (select vec_id, row_number() over (order by vec_id) as k from embeddings), h as (select vec_id as other, row_number() over (order by md5('7:' || vec_id), vec_id) as k from embeddings), r as (select vec_id, other from a join h using (k))"))
def cka_permuted_floor(spark, sf_dir):
    x, y = _halves(spark, sf_dir)
    return represent.linear_cka(x, represent.permuted(y, "row", 7)).select(F.round("cka", 6).alias("cka"))


def _attention(spark, sf_dir):
    """Attention by hash, of all vectors: two models, a pair for each vector, 2 layers, 4 heads, 8 queries of 8 weights."""
    own = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pair_id"), F.concat(F.lit("m"), (F.col("vec_id") % 2).cast("string")).alias("model"), F.lit("NL").alias("modality"))
    rows = tasks.spread(own, "pair_id").select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("c"))
    weight = lambda i: F.round(scalars.unit_hash(F.lit("7"), F.col("pair_id").cast("string"), i.cast("string")), 6)
    weights = F.array(*(weight(F.col("c") * 8 + k) for k in range(8)))
    rows = rows.select("model", "modality", "pair_id", F.expr("cast(c div 32 as int)").alias("layer"), F.expr("cast(c div 8 % 4 as int)").alias("head"), (F.col("c") % 8).alias("q"), weights.alias("w"))
    diff = own.select("pair_id", "modality", F.array((F.col("pair_id") % 8).cast("int"), ((F.col("pair_id") + 3) % 8).cast("int")).alias("diff"))
    return rows, diff


_A = """a as (select 'm' || (vec_id % 2) as model, 'NL' as modality, vec_id as pair_id, (c // 256)::int as layer, (c // 64 % 4)::int as head, c // 8 % 8 as q, c % 8 as k,
  round(('0x' || substr(md5('7:' || vec_id || ':' || c), 1, 8))::bigint / 4294967296.0::double, 6) as w from embeddings, range(512) r(c)),
h as (select *, k = pair_id % 8 or k = (pair_id + 3) % 8 as hit from a)"""


def _select_sql(where: str) -> str:
    return f"""with {_A}, s as (select model, modality, pair_id, layer, head, avg(w) filter (where hit) - avg(w) filter (where not hit) as s from h {where} group by all)
select model, modality, layer, head, round(avg(s), 6) + 0.0 as score, count(*) as n_pairs from s group by all"""


@query(_select_sql(""))
def diff_selectivity(spark, sf_dir):
    return represent.selectivity(*_attention(spark, sf_dir)).withColumn("score", F.round("score", 6) + 0.0)


@query(_select_sql("where q = 7"))
def diff_last_query(spark, sf_dir):
    return represent.selectivity(*_attention(spark, sf_dir), last_query=True).withColumn("score", F.round("score", 6) + 0.0)


@query()
def linear_probe_cv(spark, sf_dir):
    return represent.probe_accuracy(_t(spark, sf_dir, "embeddings"), "embedding", "label", 7, "vec_id")


@query("with r as (select vec_id, label, (row_number() over (partition by label order by md5('7:' || vec_id), vec_id) % 5)::int as fold from embeddings) select label, fold, count(*) as n from r group by all")
def probe_folds(spark, sf_dir):
    rows = represent.stratified_folds(_t(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", 7, "vec_id")
    return rows.groupBy("label", "fold").agg(F.count("*").alias("n"))


@query("select quality as label, count(*) as n from labels group by quality")
def label_balance(spark, sf_dir):
    return _t(spark, sf_dir, "labels").groupBy(F.col("quality").alias("label")).agg(F.count("*").alias("n"))


@query("select n_nationkey, n_name from nation where exists (select 1 from supplier where s_nationkey = n_nationkey)")
def group_semi(spark, sf_dir):
    from strandlab.sources.readers import available

    have = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return available(_t(spark, sf_dir, "nation"), have, ["n_nationkey"]).select("n_nationkey", "n_name")


@query("select r_name as task, n_name as group_name, frac from region, nation, (values (0.01::double), (0.05), (0.1), (1.0)) f(frac)")
def grid_cross(spark, sf_dir):
    """The experiment grid of three small lists."""
    fracs = spark.createDataFrame([(0.01,), (0.05,), (0.1,), (1.0,)], "frac double")
    return _t(spark, sf_dir, "region").select(F.col("r_name").alias("task")).crossJoin(_t(spark, sf_dir, "nation").select(F.col("n_name").alias("group_name"))).crossJoin(fracs)


@query("select c_custkey, regexp_replace(c_name, '[^a-zA-Z0-9]+', '_', 'g') as slug, replace(c_mktsegment || '/' || c_name, '/', '_') as tag from customer")
def slug_tags(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    return c.select("c_custkey", scalars.slug(F.col("c_name")).alias("slug"), scalars.path_tag(F.concat_ws("/", "c_mktsegment", "c_name")).alias("tag"))


@query("select event_id, coalesce(props::json->>'missing', 'gpt2') as base, (props::json->>'k')::bigint as k from events where event_type like '%lick%'")
def record_defaults(spark, sf_dir):
    e = _t(spark, sf_dir, "events").filter(F.contains("event_type", F.lit("lick")))
    p = F.from_json("props", "k bigint, missing string")
    return e.select("event_id", p.alias("p")).select("event_id", F.coalesce("p.missing", F.lit("gpt2")).alias("base"), F.col("p.k").alias("k"))


@query("""with a as (select *, row_number() over (order by vec_id) as place from embeddings where label < 5), b as (select *, row_number() over (order by vec_id) as place from embeddings where label >= 5)
select place, a.vec_id as left_id, b.vec_id as right_id from a join b using (place)""")
def aligned_rows(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    left = sampling.placed(e.filter("label < 5").select(F.col("vec_id").alias("left_id")), "left_id")
    right = sampling.placed(e.filter("label >= 5").select(F.col("vec_id").alias("right_id")), "right_id")
    return left.join(right, "place").select("place", "left_id", "right_id")


@query("""with s as (select c_mktsegment as model, avg(c_acctbal) as mean, stddev_pop(c_acctbal) as std, count(*) as n from customer group by 1),
d(model, params) as (values ('AUTOMOBILE', 4), ('BUILDING', 11), ('MACHINERY', 110)) select model, params, round(mean, 4) as mean, round(std, 4) as std, n from s join d using (model)""")
def scaling_points(spark, sf_dir):
    dim = spark.createDataFrame([("AUTOMOBILE", 4), ("BUILDING", 11), ("MACHINERY", 110)], "model string, params int")
    own = stats.summarised(_t(spark, sf_dir, "customer"), "c_acctbal", "c_mktsegment").withColumnRenamed("c_mktsegment", "model")
    return own.join(F.broadcast(dim), "model").select("model", "params", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "n")


@query(f"""with {_P}, c as (select lang, example_id % 3 as step, count(*) as n, avg((label = pred)::int) as a from p group by all)
select lang, step, n, round(greatest(a, 1 - a), 6) as transfer_flip from c""")
def step_accuracy(spark, sf_dir):
    """The transfer probe of each training step."""
    rows = _scored(spark, sf_dir).withColumn("step", F.col("example_id") % 3)
    return metrics.evaluated(rows, "lang", "step").select("lang", "step", "n", F.round("acc_flipbest", 6).alias("transfer_flip"))


@query("""with t as (select conv_id, turn, regexp_extract_all(text, '\\S+') as w from conversations)
select conv_id, turn, w[least(len(w), 16)] as last_token from t""")
def last_states(spark, sf_dir):
    """The last true place of padded arrays."""
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    ids, mask = corpus.padded(words, 16, F.lit("<pad>"))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", scalars.last_true(ids, mask).alias("last_token"))


@query(f"""with {_V}, o as (select *, greatest(0, len(a) + len(b) - 24) as o, abs(len(a) - len(b)) as gap from v),
r as (select *, least(o, gap) as one, o - least(o, gap) as rest from o)
select conv_id, turn, array_to_string(a[1:len(a) - (case when len(a) > len(b) then one else 0 end + rest // 2)], ' ') as a,
  array_to_string(b[1:len(b) - (case when len(a) > len(b) then 0 else one end + (rest + 1) // 2)], ' ') as b from r""")
def pair_truncate(spark, sf_dir):
    """Adjacent turns cut to 24 tokens together, longest first."""
    a, b = corpus.truncated_pair(F.col("a"), F.col("b"), 24)
    return _turn_pairs(spark, sf_dir).select("conv_id", "turn", F.array_join(a, " ").alias("a"), F.array_join(b, " ").alias("b"))


def _layers(spark, sf_dir, at: int):
    """Two layers of 16 features for two models: a table of hidden states."""
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.concat(F.lit("m"), (F.col("vec_id") % 2).cast("string")).alias("model"), "embedding")
    each = e.select("row", "model", "embedding", F.explode(F.array(F.lit(0), F.lit(1))).alias("layer"))
    return each.select("row", "model", "layer", F.slice("embedding", at + 16 * F.col("layer"), F.lit(16)).alias("features"))


def _layer_cka(name: str, right: str) -> str:
    sides = {"xy": ("x", "y"), "xx": ("x", "x"), "yy": ("y", "y")}
    parts = ", ".join(f"{name}_{k} as (select model, layer, sum(g * g) as s from (select a.model, a.layer, sum(a.v * b.v) as g from {name}_{p} a join {name}_{q} b using (model, layer, row) group by a.model, a.layer, a.i, b.i) group by all)" for k, (p, q) in sides.items())
    return f"""{name}_b as (select l.model, l.layer, l.row, l.x, r.y from layers l join ({right}) r using (model, layer, row)),
{name}_x as (select model, layer, row, i, v - avg(v) over (partition by model, layer, i) as v from (select model, layer, row, unnest(x)::double as v, unnest(range(16)) as i from {name}_b)),
{name}_y as (select model, layer, row, i, v - avg(v) over (partition by model, layer, i) as v from (select model, layer, row, unnest(y)::double as v, unnest(range(16)) as i from {name}_b)),
{parts}, {name} as (select model, layer, round(xy.s / (sqrt(xx.s) * sqrt(yy.s) + 1e-12), 6) as cka from {name}_xy xy join {name}_xx xx using (model, layer) join {name}_yy yy using (model, layer))"""


@query(f"""with layers as (select vec_id as row, 'm' || (vec_id % 2) as model, layer, embedding[1 + 16 * layer:16 + 16 * layer] as x, embedding[33 + 16 * layer:48 + 16 * layer] as y from embeddings, (values (0), (1)) t(layer)),
p as (select vec_id, row_number() over (order by vec_id) as k from embeddings), h as (select vec_id, row_number() over (order by md5('7:' || vec_id), vec_id) as k from embeddings),
moved as (select h.vec_id as was, p.vec_id as now from h join p using (k)),
{_layer_cka("own", "select model, layer, row, y from layers")},
{_layer_cka("dealt", "select model, layer, now as row, y from layers join moved on row = was")}
select model, layer::int as layer, own.cka, dealt.cka as cka_shuffled from own join dealt using (model, layer)""")
def cka_by_layer(spark, sf_dir):
    out = represent.layer_similarity(_layers(spark, sf_dir, 1), _layers(spark, sf_dir, 33), 7)
    return out.select("model", "layer", F.round("cka", 6).alias("cka"), F.round("cka_shuffled", 6).alias("cka_shuffled"))


# Reports over run records. Orders, customers and suppliers stand in for runs: whole numbers as scores, so that sums are exact.


def _pick_of(values: tuple, at: str):
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(at) + 1).cast("int"))


def _sql_pick(values: tuple, at: str) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::double" for v in values) + f"][1 + {at}]"


_DIRECTIONS, _SENTENCE_MODELS, _SENTENCE_TASKS = ("NL->Bio", "Bio->NL"), ("esm2_8M", "esm2_35M", "bert_tiny", "bert_small", "bert_base", "other"), ("paws-x", "cola", "rte")
_PROTEIN_MODELS, _ABLATION_GROUPS, _ABLATION_TASKS, _ABLATION_FRACS = ("esm2_8M", "bert_small", "other"), ("base", "text", "protein", "shuffled", "randomaa"), ("paws-x", "cola", "dyck_L40_t3", "dyck_L60_t3"), (0.01, 0.05, 0.1, 1.0)


def _runs(spark, sf_dir):
    """Orders as runs with nested metrics."""
    o = _t(spark, sf_dir, "orders")
    m = lambda v: F.struct(F.expr(v).cast("double").alias("acc_raw"), F.expr(v).cast("double").alias("acc_flipbest"))
    return o.select(F.col("o_orderkey").alias("seed"), _pick_of(_DIRECTIONS, "o_custkey % 2").alias("direction"), m("floor(o_totalprice) % 97").alias("transfer_pawsx_test"), m("o_custkey % 97").alias("baseline_pawsx_test"), m("o_orderkey % 89").alias("protein_indomain"))


_O = f"o as (select o_orderkey as seed, {_sql_pick(_DIRECTIONS, 'o_custkey % 2')} as direction, (floor(o_totalprice) % 97)::double as t, (o_custkey % 97)::double as b, (o_orderkey % 89)::double as i from orders)"


def _sentence_runs(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    return c.select(_pick_of(_SENTENCE_MODELS, "c_nationkey % 6").alias("model"), _pick_of(_SENTENCE_TASKS, "c_custkey % 3").alias("task"), F.floor("c_acctbal").cast("double").alias("score"))


def _protein_runs(spark, sf_dir):
    return _t(spark, sf_dir, "supplier").select(_pick_of(_PROTEIN_MODELS, "s_nationkey % 3").alias("model"), F.floor("s_acctbal").cast("double").alias("acc"))


def _ablation_runs(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    base = F.when(F.expr("c_custkey div 16 % 2 = 1"), F.lit("gpt2-medium"))
    return c.select(base.alias("base"), _pick_of(_ABLATION_GROUPS, "c_nationkey % 5").alias("group"), _pick_of(_ABLATION_TASKS, "c_custkey div 4 % 4").alias("task"), _pick_of(_ABLATION_FRACS, "c_custkey % 4").alias("frac"), F.floor("c_acctbal").cast("double").alias("score"))


_S = f"s as (select {_sql_pick(_SENTENCE_MODELS, 'c_nationkey % 6')} as model, {_sql_pick(_SENTENCE_TASKS, 'c_custkey % 3')} as task, floor(c_acctbal)::double as score from customer)"
_B = f"b as (select {_sql_pick(_PROTEIN_MODELS, 's_nationkey % 3')} as model, floor(s_acctbal)::double as acc from supplier)"
_G = f"g as (select case when c_custkey // 16 % 2 = 1 then 'gpt2-medium' end as base, {_sql_pick(_ABLATION_GROUPS, 'c_nationkey % 5')} as grp, {_sql_pick(_ABLATION_TASKS, 'c_custkey // 4 % 4')} as task, {_sql_pick(_ABLATION_FRACS, 'c_custkey % 4')} as frac, floor(c_acctbal)::double as score from customer)"


def _places(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + 0.0 for c in columns})


@query(f"with {_O} select direction, round(avg(t), 4) as mean, round(stddev_pop(t), 4) as std, count(*) as n from o group by direction")
def report_symmetry(spark, sf_dir):
    return _places(reports.symmetry(_runs(spark, sf_dir).withColumnRenamed("transfer_pawsx_test", "transfer")), "mean", "std")


@query(f"""with {_O} select count(*) as n, round(avg(t), 4) as transfer_mean, round(stddev_pop(t), 4) as transfer_std, round(avg(b), 4) as baseline_mean, round(stddev_pop(b), 4) as baseline_std,
  round(avg(i), 4) as indomain_mean, round(stddev_pop(i), 4) as indomain_std, count(*) filter (where t - b > 0.05) as above from o""")
def report_reverse_distribution(spark, sf_dir):
    return _places(reports.reverse_distribution(_runs(spark, sf_dir)), *(f"{a}_{b}" for a in ("transfer", "baseline", "indomain") for b in ("mean", "std")))


_CELLS = "avg(score) filter (where grp = 'base') as base, avg(score) filter (where grp = 'text') as text, avg(score) filter (where grp = 'protein') as protein, avg(score) filter (where grp = 'shuffled') as shuffled"


@query(f"""with {_G}, w as (select frac, {_CELLS} from g where task = 'paws-x' and frac in (0.05, 0.1, 1.0) group by frac)
select frac, round(base, 4) as base, round(text, 4) as text, round(protein, 4) as protein, round(shuffled, 4) as shuffled, round(protein - shuffled, 4) + 0.0 as structure, round(protein - text, 4) + 0.0 as biology from w""")
def report_ablation(spark, sf_dir):
    return _places(reports.ablation(_ablation_runs(spark, sf_dir)), "base", "text", "protein", "shuffled", "structure", "biology")


_M = f"with {_S}, {_B}, d(model, pretrain) as (values ('esm2_8M', 'protein'), ('bert_small', 'English'), ('bert_tiny', 'English')), x as (select model, avg(acc) as protein from b group by model), y as (select model, avg(score) as language from s where task = 'paws-x' group by model), m as (select d.model, pretrain, protein, language from d left join x on x.model = d.model left join y on y.model = d.model)"


@query(f"{_M} select model, pretrain, round(protein, 4) as protein, round(language, 4) as language from m")
def report_crossmodal(spark, sf_dir):
    return _places(reports.crossmodal(_sentence_runs(spark, sf_dir), _protein_runs(spark, sf_dir)), "protein", "language")


@query(f"{_M} select round(max(language) filter (where model = 'bert_small') - max(protein) filter (where model = 'bert_small'), 4) + 0.0 as language_drop, round(max(protein) filter (where model = 'esm2_8M') - max(language) filter (where model = 'esm2_8M'), 4) + 0.0 as protein_drop from m")
def report_off_domain_drop(spark, sf_dir):
    return _places(reports.off_domain_drop(reports.crossmodal(_sentence_runs(spark, sf_dir), _protein_runs(spark, sf_dir))), "language_drop", "protein_drop")


@query(f"""with {_S}, d(model, family, params) as (values ('esm2_8M', 'esm', 8), ('esm2_35M', 'esm', 35), ('bert_tiny', 'bert', 4), ('bert_small', 'bert', 11), ('bert_base', 'bert', 110)),
a as (select model, avg(score) as mean, stddev_pop(score) as std, count(*) as n from s where task = 'paws-x' group by model)
select family, model, params, round(mean, 4) as mean, round(std, 4) as std, n, row_number() over (partition by family order by params)::int as place from a join d using (model)""")
def report_scaling(spark, sf_dir):
    return _places(reports.scaling_ladders(_sentence_runs(spark, sf_dir)), "mean", "std")


@query(f"with {_S} select task, round(avg(score) filter (where model = 'esm2_8M'), 4) as \"esm2_8M\", round(avg(score) filter (where model = 'bert_small'), 4) as bert_small from s group by task")
def report_sentence_tasks(spark, sf_dir):
    return _places(reports.sentence_tasks(_sentence_runs(spark, sf_dir)), "esm2_8M", "bert_small")


@query(f"""with {_G}, w as (select coalesce(base, 'gpt2') as base, task, avg(score) filter (where grp = 'protein') as protein, avg(score) filter (where grp = 'shuffled') as shuffled, avg(score) filter (where grp = 'text') as text from g where task like '%dyck%' and frac = 1.0 group by 1, 2)
select base, task, round(protein, 4) as protein, round(shuffled, 4) as shuffled, round(text, 4) as text, round(protein - shuffled, 4) + 0.0 as structure from w""")
def report_brackets(spark, sf_dir):
    return _places(reports.bracket_results(_ablation_runs(spark, sf_dir)), "protein", "shuffled", "text", "structure")


@query(f"""with {_O}, u as (select 'transfer' as what, t as v from o union all select 'baseline', b from o union all select 'difference', t - b from o)
select what, count(v) as n, round(avg(v), 4) + 0.0 as mean, round(stddev_pop(v), 4) as std, round(min(v), 4) as min, round(quantile_cont(v, 0.25), 4) as p25, round(quantile_cont(v, 0.5), 4) as median, round(quantile_cont(v, 0.75), 4) as p75, round(max(v), 4) as max from u group by what""")
def report_distribution(spark, sf_dir):
    return _places(reports.distribution(_runs(spark, sf_dir)), "mean")


@query(f"with {_O} select seed, t as transfer, b as baseline, i as indomain from o order by t desc, seed limit 5")
def report_top_seeds(spark, sf_dir):
    return reports.top_seeds(_runs(spark, sf_dir))


def _similar_layers(spark, sf_dir):
    """Each vector as a model of twelve layers, keys as texts."""
    layer = lambda i: F.struct(F.floor(F.col("embedding")[i].cast("double") * 10).cast("double").alias("cka"), F.floor(F.col("embedding")[63 - i].cast("double") * 10).cast("double").alias("cka_shuffled"))
    return _t(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("model"), F.create_map(*(x for i in range(12) for x in (F.lit(str(i)), layer(i)))).alias("per_layer"))


@query("""with l as (select 'v' || vec_id as model, i::int as layer, floor(embedding[i + 1]::double * 10)::double as cka, floor(embedding[64 - i]::double * 10)::double as floor from embeddings, range(12) r(i)),
r as (select *, row_number() over (partition by model order by cka desc, layer) as r from l) select model, layer, cka, floor from r where r = 1""")
def report_best_layers(spark, sf_dir):
    return reports.best_layers(_similar_layers(spark, sf_dir))


@query("""with e as (select 'g' || label as grp, floor(embedding[12]::double * 10)::double as last, floor(embedding[10]::double * 10)::double as told from embeddings)
select grp as "group", round(avg(last), 4) + 0.0 as mean, count(*) filter (where last = told) as agree, count(*) as n from e group by grp""")
def report_last_layer_probe(spark, sf_dir):
    """The last of twelve layers by number; the recorded value is the tenth's, so some records disagree."""
    value = lambda i: F.floor(F.col("embedding")[i].cast("double") * 10).cast("double")
    rows = _t(spark, sf_dir, "embeddings").select(F.concat(F.lit("g"), F.col("label").cast("string")).alias("group"), value(9).alias("probe_acc_last"), F.create_map(*(x for i in range(12) for x in (F.lit(str(i)), value(i)))).alias("per_layer"))
    return _places(reports.last_layer_probe(rows), "mean")


@query("""select 'v' || vec_id as model, case when vec_id % 2 = 0 then 'NL' else 'protein' end as modality, label::double as max, (label * 2)::double as z, 'L' || (vec_id % 12) || 'H' || (vec_id % 7) as head from embeddings""")
def report_selectivity(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    rows = e.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("model"), F.when(F.col("vec_id") % 2 == 0, "NL").otherwise("protein").alias("modality"), F.col("label").cast("double").alias("max"), (F.col("label") * 2).cast("double").alias("z_of_max"), F.array((F.col("vec_id") % 12), (F.col("vec_id") % 7)).alias("max_head"))
    return reports.selectivity_heads(rows)
