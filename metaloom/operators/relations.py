"""Relationships of studies, experiments, samples and runs: equi-joins on accessions; physical strategies are left to the optimiser."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloom.functions import scalars

MOST_KINDS = 64


def runs_of(runs: DataFrame, experiments: DataFrame, junction: DataFrame, key: str, accession: str) -> DataFrame:
    """Runs of a study, experiment or sample, with platform and strategy of their experiment."""
    e = experiments.select("experiment_accession", "study_accession", "platform", "library_strategy")
    if key == "sample":
        e = e.join(junction.filter(F.col("sample_accession") == accession).select("experiment_accession").distinct(), "experiment_accession", "left_semi")
    else:
        e = e.filter(F.col(f"{key}_accession") == accession)
    return runs.join(e.drop("study_accession"), "experiment_accession")


def samples_of(samples: DataFrame, experiments: DataFrame, junction: DataFrame, key: str, accession: str) -> DataFrame:
    """Samples of a study or experiment: a semi-join, so no duplicates are shuffled."""
    own = experiments.filter(F.col(f"{key}_accession") == accession).select("experiment_accession")
    return samples.join(junction.join(own, "experiment_accession", "left_semi").select("sample_accession"), "sample_accession", "left_semi")


def experiments_of(experiments: DataFrame, junction: DataFrame, key: str, accession: str) -> DataFrame:
    if key == "study":
        return experiments.filter(F.col("study_accession") == accession)
    return experiments.join(junction.filter(F.col("sample_accession") == accession), "experiment_accession", "left_semi")


def studies_of(studies: DataFrame, experiments: DataFrame, runs: DataFrame, junction: DataFrame, key: str, accession: str) -> DataFrame:
    if key == "study":
        return studies.filter(F.col("study_accession") == accession)
    e = experiments.select("experiment_accession", "study_accession")
    if key == "experiment":
        e = e.filter(F.col("experiment_accession") == accession)
    elif key == "run":
        e = e.join(runs.filter(F.col("run_accession") == accession), "experiment_accession", "left_semi")
    else:
        e = e.join(junction.filter(F.col("sample_accession") == accession), "experiment_accession", "left_semi")
    return studies.join(e, "study_accession", "left_semi")


def edges(experiments: DataFrame, runs: DataFrame, junction: DataFrame, identifiers: DataFrame | None = None, unique: bool = True) -> DataFrame:
    """``src_type, src, dst_type, dst`` of every supported conversion, each once unless ``unique`` is False.

    Pairs are made distinct before they are turned into the edges of both directions, which then share one shuffle.
    """

    def pairs(df: DataFrame, x: str, y: str) -> DataFrame:
        some = df.select(x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        return some.distinct() if unique else some

    e = experiments.select("experiment_accession", "study_accession")
    own = {
        ("SRP", "SRX"): pairs(e, "study_accession", "experiment_accession"),
        ("SRP", "SRR"): pairs(e.join(runs.select("run_accession", "experiment_accession"), "experiment_accession"), "study_accession", "run_accession"),
        ("SRP", "SRS"): pairs(e.join(junction.select("experiment_accession", "sample_accession"), "experiment_accession"), "study_accession", "sample_accession"),
        ("SRX", "SRR"): pairs(runs, "experiment_accession", "run_accession"),
        ("SRX", "SRS"): pairs(junction, "experiment_accession", "sample_accession"),
    }
    if identifiers is not None:
        ext = identifiers.filter("id_type = 'external'")
        own["SRS", "BIOSAMPLE"] = pairs(ext.filter("record_type = 'sample' and id_namespace = 'BioSample'"), "record_accession", "id_value")
        own["SRP", "GSE"] = pairs(ext.filter("record_type = 'study' and id_namespace = 'GEO'"), "record_accession", "id_value")
    rows = lambda df, a, x, b, y: df.select(F.lit(a).alias("src_type"), F.col(x).alias("src"), F.lit(b).alias("dst_type"), F.col(y).alias("dst"))
    parts = [rows(df, a, df.columns[0], b, df.columns[1]) for (a, b), df in own.items()]
    parts += [rows(df, b, df.columns[1], a, df.columns[0]) for (a, b), df in own.items() if (a, b) != ("SRP", "SRS")]
    return reduce(DataFrame.unionByName, parts)


def source_system(acc):
    """``SRP`` for ERP and DRP as well; BIOSAMPLE for SAM*; else the system itself."""
    return F.regexp_replace(F.regexp_replace(scalars.id_system(acc), "^[SED]R([PXSR])$", "SR$1"), "^SAM.*$", "BIOSAMPLE")


def _asked(wanted: DataFrame, edge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalised ``source, target_type, system``, and the edges of the kinds that are asked for."""
    w = wanted.select(scalars.normalised_accession(F.col("source")).alias("source"), F.upper("target_type").alias("target_type")).withColumn("system", source_system(F.col("source")))
    # Few kinds are asked for: known by name, they keep the other edges from being made.
    kinds = [tuple(r) for r in w.select("system", "target_type").filter("system <> '' and target_type is not null").distinct().limit(MOST_KINDS + 1).collect()]
    if len(kinds) <= MOST_KINDS:
        edge = edge.filter(reduce(Column.__or__, ((F.col("src_type") == a) & (F.col("dst_type") == b) for a, b in kinds), F.lit(False)))
    return w, edge


def _targets(w: DataFrame, edge: DataFrame) -> DataFrame:
    met = w.join(edge, (w["source"] == edge["src"]) & (w["target_type"] == edge["dst_type"]) & (w["system"] == edge["src_type"]))
    # The system follows from the source; with it, groups lie as the join has dealt them.
    return met.groupBy("source", "system", "target_type").agg(F.sort_array(F.collect_set("dst")).alias("targets")).drop("system")


def converted(wanted: DataFrame, edge: DataFrame) -> DataFrame:
    """What :func:`convert` finds, without the rows that have an error: edges are read once, and may come more than once."""
    return _targets(*_asked(wanted, edge))


def convert(wanted: DataFrame, edge: DataFrame) -> DataFrame:
    """``wanted``: source, target_type. One row each with its sorted targets and an error, where there is none to give."""
    w, edge = _asked(wanted, edge)
    known = edge.select("src_type", "dst_type").distinct()
    got = _targets(w, edge)
    pairs = known.select(F.col("src_type").alias("system"), F.col("dst_type").alias("target_type"), F.lit(True).alias("supported"))
    out = w.join(got, ["source", "target_type"], "left").join(F.broadcast(pairs), ["system", "target_type"], "left")
    error = F.when(F.col("system") == "", "unknown accession").when(F.col("supported").isNull(), "unsupported conversion").when(F.col("targets").isNull(), "not found")
    return out.select("source", "target_type", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"), error.alias("error"))


def expand_to_runs(accessions: DataFrame, edge: DataFrame) -> DataFrame:
    """Runs of any accessions, ordered; a run stands for itself; studies and samples go through their experiments. Edges may come more than once."""
    a = accessions.select(scalars.normalised_accession(F.col("accession")).alias("accession")).withColumn("system", source_system(F.col("accession")))
    to = lambda kinds, dst: edge.filter(F.col("src_type").isin(*kinds) & (F.col("dst_type") == dst)).select("src", "dst")
    met = lambda df, e: df.join(e, F.col("accession") == F.col("src")).select(F.col("dst").alias("accession")).distinct()
    experiments = a.select("accession").union(met(a, to(["SRP", "SRS"], "SRX")))
    own = a.filter("system = 'SRR'").select(F.col("accession").alias("run_accession"))
    return own.union(met(experiments, to(["SRX"], "SRR"))).distinct().orderBy("run_accession")


def experiment_rows(experiments: DataFrame, junction: DataFrame) -> DataFrame:
    """A row for each experiment and sample; experiments without a sample stay."""
    return experiments.join(junction, "experiment_accession", "left")


def wide(runs: DataFrame, experiments: DataFrame, samples: DataFrame, junction: DataFrame, studies: DataFrame) -> DataFrame:
    """The denormalised record of each run and sample, with metrics as numbers (null counts as 0 where the other is known)."""
    some = F.col("total_spots").isNotNull() | F.col("total_bases").isNotNull()
    metric = lambda c: F.when(some, F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return (
        runs.select("run_accession", "experiment_accession", metric("total_spots").alias("spots"), metric("total_bases").alias("bases"))
        .join(experiments.select("experiment_accession", "study_accession", "platform", "library_strategy"), "experiment_accession")
        .join(junction, "experiment_accession")
        .join(samples.select("sample_accession", "tissue", "taxon_id"), "sample_accession")
        .join(studies.select("study_accession", "study_title", "study_type"), "study_accession")
    )


def enriched_studies(studies: DataFrame, experiments: DataFrame, junction: DataFrame, runs: DataFrame) -> DataFrame:
    """Each study with the distinct platforms, strategies and tissues-to-come of its children. Children are aggregated before they are joined: samples and runs do not multiply."""
    e = experiments.select("experiment_accession", "study_accession", "platform", "library_strategy")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    of_e = e.groupBy("study_accession").agg(listed("platform").alias("platforms"), listed("library_strategy").alias("strategies"), F.countDistinct("experiment_accession").alias("experiments"))
    keys = e.select("experiment_accession", "study_accession")
    of_s = junction.join(keys, "experiment_accession").groupBy("study_accession").agg(F.countDistinct("sample_accession").alias("samples"))
    of_r = runs.join(keys, "experiment_accession").groupBy("study_accession").agg(F.countDistinct("run_accession").alias("runs"))
    out = studies.join(of_e, "study_accession", "left").join(of_s, "study_accession", "left").join(of_r, "study_accession", "left")
    return out.na.fill(0, ["experiments", "samples", "runs"]).na.fill("", ["platforms", "strategies"])


def without_orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is there; a blank key is kept."""
    blank = F.col(key).isNull() | (F.col(key) == "")
    return children.filter(blank).unionByName(children.filter(~blank).join(parents.select(key), key, "left_semi").select(*children.columns))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def experiment_full(experiments: DataFrame, studies: DataFrame, samples: DataFrame, junction: DataFrame) -> DataFrame:
    return experiments.join(studies.select("study_accession", "study_title", "organism"), "study_accession", "left").join(junction, "experiment_accession", "left").join(samples.select("sample_accession", "tissue", "cell_type"), "sample_accession", "left")


def run_stats(runs: DataFrame, experiments: DataFrame, studies: DataFrame) -> DataFrame:
    return runs.join(experiments.select("experiment_accession", "study_accession", "platform"), "experiment_accession", "left").join(studies.select("study_accession", "study_title"), "study_accession", "left")


def experiment_pools(experiments: DataFrame, junction: DataFrame, pools: DataFrame) -> DataFrame:
    return experiments.join(junction, "experiment_accession").join(pools, F.col("sample_accession") == F.col("parent_sample"), "left")


def experiment_pool_sizes(experiments: DataFrame, junction: DataFrame, pools: DataFrame) -> DataFrame:
    """``experiment_accession, sample_accession, members`` of :func:`experiment_pools`, counted before pools are joined: their members multiply nothing."""
    sizes = pools.groupBy(F.col("parent_sample").alias("sample_accession")).agg(F.count("member_sample").alias("members"))
    met = experiments.select("experiment_accession").join(junction.select("experiment_accession", "sample_accession"), "experiment_accession").join(sizes, "sample_accession", "left")
    return met.groupBy("experiment_accession", "sample_accession").agg(F.coalesce(F.sum("members"), F.lit(0)).cast("long").alias("members"))


def related_studies(studies: DataFrame, related: DataFrame) -> DataFrame:
    """``related``: study_accession, related_accession; titles of both ends (self-join)."""
    a, b = studies.select("study_accession", "study_title"), studies.select(F.col("study_accession").alias("related_accession"), F.col("study_title").alias("related_title"))
    return a.join(related, "study_accession").join(b, "related_accession", "left")


def study_bundle(studies: DataFrame, experiments: DataFrame, junction: DataFrame, runs: DataFrame, limit: int = 100) -> DataFrame:
    """Each study with its counts and its first runs by accession. Pairs of ``junction`` may come more than once."""
    keys = experiments.select("experiment_accession", "study_accession")
    own = runs.join(keys, "experiment_accession").select("study_accession", "run_accession")
    rank = F.row_number().over(Window.partitionBy("study_accession").orderBy("run_accession"))
    first = own.withColumn("rank", rank).filter(F.col("rank") <= limit).groupBy("study_accession").agg(F.array_sort(F.collect_list("run_accession")).alias("first_runs"))
    counts = own.groupBy("study_accession").agg(F.count("*").alias("n_runs"))
    n_e = keys.groupBy("study_accession").agg(F.count("*").alias("n_experiments"))
    n_s = junction.join(keys, "experiment_accession").groupBy("study_accession").agg(F.countDistinct("sample_accession").alias("n_samples"))
    out = studies.select("study_accession", "study_title")
    for part in (n_e, n_s, counts, first):
        out = out.join(part, "study_accession", "left")
    return out.na.fill(0, ["n_experiments", "n_samples", "n_runs"])


def accession_types(wanted: DataFrame, entities: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Of each accession the first entity, in the given order, that has it."""
    found = None
    for i, (name, df, key) in enumerate(entities):
        part = df.select(F.col(key).alias("accession"), F.lit(i).alias("priority"), F.lit(name).alias("type"))
        found = part if found is None else found.unionByName(part)
    best = found.join(wanted.select("accession").distinct(), "accession", "left_semi").groupBy("accession").agg(F.min_by("type", "priority").alias("type"))
    return wanted.select("accession").distinct().join(best, "accession", "left").withColumn("type", F.coalesce("type", F.lit("unknown")))


def cascade(levels: list[tuple[DataFrame, str]]) -> list[DataFrame]:
    """A filter carried down: of each level, from the filtered first on, the rows whose parent is left. A level is a frame and its key, which the next one holds too."""
    out = [levels[0][0]]
    for (_, key), (child, _) in zip(levels, levels[1:], strict=False):
        out.append(child.join(out[-1].select(key), key, "left_semi"))
    return out


def lookup(df: DataFrame, key: str, accession: str) -> DataFrame:
    """The row of one accession; the equality reaches the scan."""
    return df.filter(F.col(key) == accession)


def with_metrics(runs: DataFrame) -> DataFrame:
    """Runs that have spots or bases, as ``spots`` and ``bases`` (a missing one counts 0)."""
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return runs.filter(F.col("total_spots").isNotNull() | F.col("total_bases").isNotNull()).withColumns({"spots": number("total_spots"), "bases": number("total_bases")})
