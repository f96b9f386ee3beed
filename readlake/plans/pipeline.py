"""Pipelines as data: inputs, operators per input, how inputs are combined, and branches that end in an output."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from readlake.mapping.align import Aligner
from readlake.operators import chains, combine, contigs, divergence, filters, intervals, rmdup, sorting, stats, transforms
from readlake.sinks import text
from readlake.sources import read, reader



def _regions(inside: bool) -> Callable:
    def make(path: str, key: str = "read_id") -> Callable:
        return lambda df: intervals.in_regions(df, reader.read_regions(df.sparkSession, path), inside, key)

    return make


def _agrees(left: str, right: str, path: str, key: str = "read_id") -> Callable:
    return lambda df: chains.agrees_with_chain(left, right, reader.read_chains(df.sparkSession, path), key)(df)


def _alignments(contigs_path: str, key: str = "read_id", context: int = 0) -> Callable:
    """Textual alignments from contig bases kept as Parquet (genome_name, sequence, range_start, bases)."""
    return lambda df: transforms.add_alignments(df, transforms.reference_chunks(df.sparkSession.read.parquet(contigs_path)), key, context)


#: Operators by the names that specs use.
OPERATORS: dict[str, Callable] = {
    "filter-score": filters.filter_score,
    "filter-total-score": filters.filter_total_score,
    "filter-mapq": filters.filter_mapq,
    "filter-qual": filters.filter_quality,
    "filter-length": filters.filter_length,
    "filter-gc": filters.filter_gc,
    "filter-multi": filters.filter_multi,
    "ignore-hit": filters.ignore_hits,
    "only-genomes": filters.only_genomes,
    "require-hit": filters.require_hit,
    "require-best-hit": filters.require_best_hit,
    "subsample": filters.subsample,
    "mask-qual": transforms.mask_quality,
    "trim": transforms.trim,
    "sanitize": lambda: transforms.drop_statistics,
    "sort-pos": sorting.sort_by_position,
    "sort-name": sorting.sort_by_name,
    "rmdup": rmdup.remove_duplicates,
    "inside-region": _regions(True),
    "outside-region": _regions(False),
    "filter-chain": _agrees,
    "add-alns": _alignments,
    "duct-tape": lambda **k: lambda df: contigs.duct_tape(df, **k),
}
COMBINE: dict[str, Callable] = {"concat": combine.concat, "join": combine.join_reads, "merge": lambda *d: combine.merge_same_reads(combine.concat(*d))}
OUTPUT: dict[str, Callable] = {
    "native": lambda df, path, **k: text.write_records(df, path, **k),
    "text": lambda df, path: text.write_lines(text.text_lines(df), path),
    "sam": lambda df, path, **k: text.write_lines(text.sam_lines(df), path, text.sam_header(**k)),
    "fasta": lambda df, path, **k: text.write_lines(text.fasta_alignment_lines(df, **k), path),
    "fastq": lambda df, path, **k: text.write_lines(text.fastq_lines(df, **k), path),
    "table": lambda df, path, **k: text.table_lines(df, **k).write.mode("overwrite").option("sep", "\t").csv(path),
    "wiggle": lambda df, path: text.write_lines(text.wiggle_lines(df), path),
    "stats": lambda df, path: stats.stats(df).write.mode("overwrite").json(path),
    "divergence": lambda df, path, primary, secondary, **k: divergence.divergence(divergence.divergence_counts(primary, secondary, **k)(df)).write.mode("overwrite").json(path),
    "mismatches": lambda df, path: stats.mismatches(df).write.mode("overwrite").json(path),
}
Step = tuple[str, dict]


@dataclass
class Branch:
    steps: Sequence[Step]
    output: str
    path: str
    options: dict = field(default_factory=dict)


@dataclass
class Pipeline:
    """Inputs with the steps that each goes through, the combination (concat, join or merge), and the branches."""

    inputs: Sequence[tuple[str, Sequence[Step]]]
    branches: Sequence[Branch]
    combination: str = "concat"

    def __post_init__(self) -> None:
        for name, _ in [s for _, steps in self.inputs for s in steps] + [s for b in self.branches for s in b.steps]:
            if name not in OPERATORS:
                raise ValueError(f"unknown operator {name}")
        if self.combination not in COMBINE or any(b.output not in OUTPUT for b in self.branches):
            raise ValueError("unknown combination or output")

    def explain(self) -> str:
        """The pipeline in words, without running it."""
        show = lambda steps: "".join(f" | {n}" + (f"({', '.join(f'{k}={v!r}' for k, v in o.items())})" if o else "") for n, o in steps)
        lines = [f"read {p}{show(steps)}" for p, steps in self.inputs]
        return "\n".join([*lines, self.combination, *(f"  {show(b.steps).lstrip(' |') or 'as is'} -> {b.output} {b.path}" for b in self.branches)])

    def combined(self, spark: SparkSession, **reader) -> DataFrame:
        parts = [_through(read(spark, p, **reader), steps) for p, steps in self.inputs]
        return COMBINE[self.combination](*parts)

    def run(self, spark: SparkSession, **reader) -> dict[str, str]:
        """Runs all branches over one computed input; the path of each output."""
        df = self.combined(spark, **reader)
        df = df.cache() if len(self.branches) > 1 else df
        for b in self.branches:
            OUTPUT[b.output](_through(df, b.steps), b.path, **b.options)
        return {b.path: b.output for b in self.branches}


def _through(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    return combine.chain(*(OPERATORS[n](**o) for n, o in steps))(df)


def parse_config(text_: str) -> dict:
    """A nested dict of a configuration of 'name: value' and 'name { ... }' entries; repeated names become lists; # starts a comment."""
    import re

    tokens = re.findall(r'"(?:[^"\\]|\\.)*"|[{}:]|[^\s{}:"#]+|#[^\n]*', text_)
    tokens = [t for t in tokens if not t.startswith("#")]

    def value(t: str):
        if t[0] == '"':
            return t[1:-1].encode().decode("unicode_escape")
        for f in (int, float):
            try:
                return f(t)
            except ValueError:
                pass
        return {"true": True, "false": False}.get(t, t)

    def block(i: int) -> tuple[dict, int]:
        out: dict = {}
        while i < len(tokens) and tokens[i] != "}":
            name = tokens[i]
            i += 1
            if tokens[i] == ":":
                i += 1
            if tokens[i] == "{":
                v, i = block(i + 1)
            else:
                v, i = value(tokens[i]), i + 1
            out[name] = [*out[name], v] if isinstance(out.get(name), list) else [out[name], v] if name in out else v
        return out, i + 1

    return block(0)[0]


def _listed(x) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def policies_of(spark: SparkSession, config: dict) -> DataFrame:
    """The policies of a parsed configuration as filters.select_policies and mapper.map_by_policy take them, in order of the file."""
    schema = (
        "position int, minlength int, maxlength int, name_pattern string, min_seed_len int, max_mismatches_in_seed int, repeat_threshold int,"
        " indices array<struct<name:string,wordsize:int,stride:int,cutoff:int,allow_near_perfect:boolean>>"
    )
    rows = []
    for i, p in enumerate(_listed(config.get("policy"))):
        indices = [(x["name"], x.get("wordsize"), x.get("stride"), x.get("cutoff"), bool(x.get("allow_near_perfect", 0))) for x in _listed(p.get("use_compact_index"))]
        rows.append((i, *(p.get(c) for c in ("minlength", "maxlength", "name_pattern", "min_seed_len", "max_mismatches_in_seed", "repeat_threshold")), indices))
    return spark.createDataFrame(rows, schema)


def aligner_of(config: dict) -> Aligner:
    """The aligner of a parsed configuration; the default one where it has none."""
    names = {
        "rate_of_transversions": "transversions", "rate_of_transitions": "transitions", "gap_open_rate": "gap_open", "gap_extension_rate": "gap_extension", "rate_of_ds_deamination": "ds_deamination",
        "rate_of_ss_deamination": "ss_deamination", "mean_overhang_length": "mean_overhang", "max_penalty_per_nuc": "max_penalty_per_nuc", "max_mapq": "max_mapq",
    }
    return Aligner(**{names[k]: v for k, v in config.get("aligner", {}).items() if k in names})


def trimmer_of(config: dict) -> Callable:
    """The trim step of a parsed configuration."""
    return transforms.trim(_listed(config.get("trim_left")), _listed(config.get("trim_right")), config.get("min_trim_score", 4))
