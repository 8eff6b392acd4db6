"""What a table is (columns, target, task) and what to do with it (options)."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGRESSION, BINARY, MULTICLASS = "regression", "binary", "multiclass"

# Which numeric statistics each variant shows, in display order.
STAT_VARIANTS = {
    "mean_only": ["mean"],
    "mean_std": ["mean", "std"],
    "no_minmax": ["mean", "std", "p25", "p50", "p75"],
    "full": ["mean", "std", "p25", "p50", "p75", "min", "max"],
}


@dataclass(frozen=True)
class TableSpec:
    """Columns and task of a labelled table; NULL column lists are inferred from the schema."""

    name: str
    target: str
    task: str
    cat_cols: tuple[str, ...] | None = None
    num_cols: tuple[str, ...] | None = None
    key: str = "_row_id"
    display_name: str | None = None
    label_display: Mapping[str, str] = field(default_factory=dict)
    descriptions: Mapping[str, str] = field(default_factory=dict)
    description_order: bool = False
    text_by_features: bool = False
    extra_match_cols: tuple[str, ...] = ()

    @property
    def target_name(self) -> str:
        return self.display_name or self.target

    @property
    def is_regression(self) -> bool:
        return self.task == REGRESSION

    def resolve(self, df: DataFrame) -> TableSpec:
        """Fix the feature lists against the columns a table really has."""
        fields = [f for f in df.schema.fields if f.name not in (self.target, self.key, "split")]
        names = [f.name for f in fields]
        if self.cat_cols is not None:
            cats = tuple(c for c in self.cat_cols if c in names)
        else:
            cats = tuple(f.name for f in fields if isinstance(f.dataType, (T.StringType, T.BooleanType)))
        if self.num_cols is not None:
            nums = tuple(c for c in self.num_cols if c in names)
        else:
            nums = tuple(c for c in names if c not in cats)
        return replace(self, cat_cols=cats, num_cols=nums)

    @property
    def feature_cols(self) -> tuple[str, ...]:
        features = tuple(self.num_cols or ()) + tuple(self.cat_cols or ())
        if self.description_order:
            return tuple(c for c in self.descriptions if c in features)
        return features

    @property
    def text_order(self) -> tuple[str, ...]:
        """Described features first, in description order, then the rest (or plain feature order)."""
        if self.text_by_features:
            return self.feature_cols
        first = tuple(c for c in self.descriptions if c in self.feature_cols)
        return first + tuple(c for c in self.feature_cols if c not in first)

    @property
    def match_cols(self) -> tuple[str, ...]:
        """Categorical columns in the order in which retrieval applies them."""
        ordered = dict.fromkeys(tuple(self.cat_cols or ()) + self.extra_match_cols)
        return tuple(c for c in ordered if c in self.feature_cols)

    @property
    def vector_cols(self) -> tuple[str, ...]:
        return tuple(c for c in self.feature_cols if c not in self.match_cols)


@dataclass(frozen=True)
class TaskSpec:
    """Text and label behaviour of a task, as functions from column to column."""

    render_target: Callable[[Column], Column]
    parse: Callable[[Column], Column]
    to_target: Callable[[Column], Column]
    sentence: Callable[[Column], Column]
    instructions: Mapping[str, str] = field(default_factory=dict)
    binarize: Callable[[Column], Column] | None = None
    from_target: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class CorpusSpec:
    """Options of a corpus build."""

    mode: str = "zeroshot"
    with_stats: bool = False
    stats_block: bool = True
    stats_header: bool = True
    per_group: bool = False
    inline_stats: bool = False
    inline_header: bool = False
    variant: str = "full"
    top_k: int | None = 5
    with_cases: bool = False
    n_cases: int = 16
    balanced: bool = False
    random_cases: bool = False
    show_similarity: bool = True
    cases_after_query: bool = False
    limit: int | None = None
    undersampling: bool = False
    seed: int = 42

    def __post_init__(self):
        if self.variant not in STAT_VARIANTS:
            raise ValueError(f"unknown variant {self.variant!r}; known: {list(STAT_VARIANTS)}")
        if self.mode not in ("zeroshot", "reasoning", "finetune", "normal_finetune"):
            raise ValueError(f"unknown mode {self.mode!r}")


_TABLES: dict[str, TableSpec] = {}
_TASKS: dict[str, TaskSpec] = {}


def register(table: TableSpec, task: TaskSpec | None = None) -> None:
    _TABLES[table.name] = table
    if task is not None:
        _TASKS[table.name] = task


def table_spec(name: str) -> TableSpec:
    if name not in _TABLES:
        raise ValueError(f"unknown table {name!r}; known: {sorted(_TABLES)}")
    return _TABLES[name]


def task_spec(name: str) -> TaskSpec:
    if name not in _TASKS:
        raise ValueError(f"no task registered for {name!r}; known: {sorted(_TASKS)}")
    return _TASKS[name]


def project(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Key, features (categories as text, whole numbers kept, others as double, missing values normalised), target."""
    from corpusforge.operators.cleaning import category, number

    spec = spec.resolve(df)
    whole = {f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}
    return df.select(
        F.col(spec.key).cast("bigint").alias("_row_id"),
        *[F.col(c) if c in whole else number(F.col(c)).alias(c) for c in spec.num_cols],
        *[category(F.col(c)).alias(c) for c in spec.cat_cols],
        F.col(spec.target),
    )
