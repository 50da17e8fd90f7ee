"""The data of each report plot as tables; drawing is left to the user."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tracer import rot90
from ..schema import known, require
from .linalg import first_position, scale_columns
from .stats import box_stats, colour_limits, pair_regressions, rank_tests, regression_lines, regressions, violins

GOLDEN = 1.618


def figure_size(n_components: int, n_columns: int, page_width: float, ratio: float = GOLDEN, title_margin: bool = True) -> tuple[float, float]:
    """Width and height in inches of a grid of plots with a tenth of each row for its title."""
    return page_width, page_width / n_columns / ratio * n_components * (1.1 if title_margin else 1.0)


def plane_widths(shape: tuple[int, int, int], bar: float = 0.05) -> list[float]:
    """Width ratios of the three planes of a volume and their colour bar."""
    return [1.0, shape[0] / shape[1], shape[0] / shape[2], bar]


def grid_widths(shape: tuple[int, int, int], bar: float = 0.2, axis: int = 0) -> tuple[list[float], float]:
    """Width ratios of the mode grid (curve, boxes, two slices across `axis` with a colour bar of the share `bar`), and the plots' ratio of width to height."""
    height, width = (n for k, n in enumerate(shape) if k != axis)
    image = height / width * (1.0 + bar)
    widths = [1.0, 1.0, image, image]
    return widths, image / (sum(widths) / len(widths))


def palette(n: int) -> list[str]:
    """Every third colour of the default cycle."""
    return [f"C{3 * k}" for k in range(n)]


def named_components(mode: DataFrame, key: str, rank: int) -> DataFrame:
    """Wide table key, comp_0 ... of scaled long rows (key, r, value)."""
    wide = scale_columns(mode, ["r"]).groupBy(key).pivot("r", list(range(rank))).agg(F.first("value"))
    return wide.select(key, *[F.col(str(r)).alias(f"comp_{r}") for r in range(rank)])


def subject_table(mode: DataFrame, info: DataFrame, group: str, rank: int, variables: tuple[str, ...] = ()) -> DataFrame:
    """Scaled components merged with subject metadata (inner, on subjects).

    Raises ValueError for missing columns, an empty merge, fewer rows than subjects and
    fewer than two groups. Metadata that repeats a subject repeats its row.
    """
    require(info, "subjects", group, *variables)
    wide = named_components(mode, "subjects", rank)
    merged = wide.join(info, "subjects")
    subjects = wide.count()
    rows, groups = merged.agg(F.count(F.lit(1)), F.countDistinct(group)).first()
    if not rows:
        raise ValueError("no subject of the mode is in the metadata")
    if rows < subjects:
        raise ValueError(f"{subjects - rows} subjects are not in the metadata")
    if groups < 2:
        raise ValueError(f"{group!r} needs at least 2 groups, found {groups}")
    return merged


def long_components(table: DataFrame, rank: int, *keep: str) -> DataFrame:
    """keep, component, value: a wide table of comp_0 ... as rows."""
    cells = F.array(*[F.struct(F.lit(r).alias("component"), F.col(f"comp_{r}").alias("value")) for r in range(rank)])
    return table.select(*keep, F.inline(cells))


#: Half a strip, in units of the distance of two boxes; and the share of the range that a plot leaves above it.
JITTER, MARGIN = 0.2, 0.05


def strip_points(long: DataFrame, group: str) -> DataFrame:
    """component, subjects, group, pos, at, value: every point beside its box, moved aside by a hash of its subject."""
    pos = first_position(long, group, ["subjects"])
    aside = (F.pmod(F.xxhash64("subjects", "component"), F.lit(1_000_001)) / 1_000_000.0 * 2.0 - 1.0) * JITTER
    return long.join(pos, group).select("component", "subjects", group, "pos", (F.col("pos") + aside).alias("at"), "value")


def box_limits(long: DataFrame, group: str, legend: float | None = None) -> DataFrame:
    """component, y_low, y_high, x_low, x_high: limits of each row of box plots, the same x for all.

    legend is the width of a legend in units of x; None is without one.
    """
    groups = long.agg(F.countDistinct(group).alias("_groups"))
    x = known(F.col("value"))
    rows = long.groupBy("component").agg((F.max(x) + MARGIN * (F.max(x) - F.min(x))).alias("y_high")).join(F.broadcast(groups))  # one row is broadcast
    right = F.col("_groups") - 1 + (0.25 if legend is None else 0.325 + legend)
    return rows.select("component", F.lit(0.0).alias("y_low"), "y_high", F.lit(-0.25).alias("x_low"), right.alias("x_high"))


@dataclass
class SubjectReport:
    """Per component: boxes or violins, their points, rank tests and limits by group, and a regression on each variable by group.

    Each table is made when it is first asked for. table is a subject_table; legend is
    the width of a legend in units of x.
    """

    table: DataFrame
    rank: int
    group: str
    variables: tuple[str, ...] = ()
    legend: float = 0.0

    @cached_property
    def long(self) -> DataFrame:
        return long_components(self.table, self.rank, "subjects", self.group, *self.variables)

    @cached_property
    def boxes(self) -> DataFrame:
        return box_stats(self.long, ["component", self.group], "value")

    @cached_property
    def violins(self) -> DataFrame:
        return violins(self.long, ["component", self.group], "value", ["component"])

    @cached_property
    def tests(self) -> DataFrame:
        return rank_tests(self.long, self.group, "value", ["subjects"], ("component",))

    @cached_property
    def points(self) -> DataFrame:
        kind = "array<struct<variable:string,x:double>>"
        each = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in self.variables]).cast(kind)
        return self.long.select("subjects", self.group, "component", F.col("value").alias("y"), F.inline(each))

    @cached_property
    def regressions(self) -> DataFrame:
        return regressions(self.points, ["variable", "component", self.group], "x", "y")

    @cached_property
    def lines(self) -> DataFrame:
        return regression_lines(self.regressions, self.points, "x", by=("variable",))

    @cached_property
    def strips(self) -> DataFrame:
        return strip_points(self.long, self.group)

    @cached_property
    def limits(self) -> DataFrame:
        return box_limits(self.long, self.group, self.legend)


@dataclass
class ComponentReport(SubjectReport):
    """Boxes and rank tests of each component on the diagonal, regressions of all ordered pairs beside it.

    limits has a row for each cell (component_y, component_x): a row of plots shares the
    y-limits of its boxes; beside the diagonal x has the limits that component_x has as a y.
    """

    @cached_property
    def points(self) -> DataFrame:
        return component_points(self.table, self.rank, self.group)

    @cached_property
    def regressions(self) -> DataFrame:
        return pair_regressions(self.table, [f"comp_{r}" for r in range(self.rank)], self.group)

    @cached_property
    def lines(self) -> DataFrame:
        return regression_lines(self.regressions, self.points, "x", by=("component_x",))

    @cached_property
    def limits(self) -> DataFrame:
        own = box_limits(self.long, self.group, self.legend)
        across = own.select(F.col("component").alias("component_x"), F.col("y_low").alias("_low"), F.col("y_high").alias("_high"))
        cells = own.withColumnRenamed("component", "component_y").withColumn("component_x", F.explode(F.sequence(F.lit(0), F.lit(self.rank - 1)))).join(across, "component_x")
        diagonal = F.col("component_x") == F.col("component_y")
        x = [F.when(diagonal, F.col(f"x{side}")).otherwise(F.col(side)).alias(f"x{side}") for side in ("_low", "_high")]
        return cells.select("component_y", "component_x", "y_low", "y_high", *x)


def component_points(table: DataFrame, rank: int, group: str) -> DataFrame:
    """group, component_x, x, component_y, y: the points of every ordered pair of components."""
    held = table.select(group, F.array(*[F.col(f"comp_{a}").cast("double") for a in range(rank)]).alias("_c"))
    pairs = held.select(group, "_c", F.posexplode("_c").alias("component_x", "x")).select(group, "component_x", "x", F.posexplode("_c").alias("component_y", "y"))
    return pairs.where("component_x != component_y")


def component_correlations(table: DataFrame, rank: int, group: str) -> DataFrame:
    """Regressions by group of component_y on component_x for every ordered pair of components."""
    return ComponentReport(table, rank, group).regressions


def scatter_to_grid(values: DataFrame, index: DataFrame, tissue: str | None = None) -> DataFrame:
    """r, i, j, k, value: a long spatial mode (l, r, value) at its voxels, sparse; unset voxels are 0."""
    held = index.where(F.col(tissue)) if tissue else index
    return values.join(held.select("l", "i", "j", "k"), "l").select("r", "i", "j", "k", "value")


def slice_pixels(grid: DataFrame, shape: tuple[int, int, int], axis: int, at: int) -> DataFrame:
    """row, col, value and the other columns of one slice, turned for display (axis 0 is also mirrored)."""
    names = ["i", "j", "k"]
    a, b = (n for k, n in enumerate(names) if k != axis)
    height, width = (n for k, n in enumerate(shape) if k != axis)
    row, col = rot90(F.col(a), F.col(b), height, width, flip=axis == 0)
    return grid.where(F.col(names[axis]) == at).select(*[c for c in grid.columns if c not in [*names, "value"]], row.alias("row"), col.alias("col"), "value")


TISSUES = ("csf", "parenchyma")


def tissue_grid(values: DataFrame, index: DataFrame) -> DataFrame:
    """tissue, r, i, j, k, value: a long spatial mode (l, r, value), scaled, at the voxels of each tissue.

    Raises ValueError unless every component has a row for each row of the index.
    """
    sizes = values.groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l").alias("d")).agg(F.min("n"), F.max("n"), F.min("d")).first()
    voxels = index.count()
    if any(n is not None and n != voxels for n in sizes):
        raise ValueError(f"the spatial mode has {sizes[0]} to {sizes[1]} rows for each component, the index {voxels}")
    member = F.inline(F.filter(F.array(*[F.struct(F.lit(t).alias("tissue"), F.col(f"is_{t}").alias("_in")) for t in TISSUES]), lambda s: s["_in"]))
    held = index.select("l", "i", "j", "k", member).drop("_in")
    return scale_columns(values, ["r"]).join(held, "l").select("tissue", "r", "i", "j", "k", "value")


def spatial_report(values: DataFrame, index: DataFrame, shape: tuple[int, int, int], at: tuple[int, int, int]) -> tuple[DataFrame, DataFrame]:
    """(pixels, limits) of cerebrospinal fluid and parenchyma: tissue, plane, r, row, col, value and tissue, r, vmin, vmax."""
    grid = tissue_grid(values, index)
    planes = [slice_pixels(grid, shape, k, at[k]).withColumn("plane", F.lit(k)) for k in range(3)]
    return reduce(DataFrame.unionByName, planes), colour_limits(grid, ["tissue", "r"], "value")


def overlay(foreground: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Pixels of an overlay that are shown: those of the mask, or without one those that aren't zero."""
    if mask is not None:
        return foreground.join(mask.select("row", "col").distinct(), ["row", "col"], "left_semi")
    return foreground.where(F.abs("value") > 1e-8)


def enhancement(background: DataFrame, foreground: DataFrame, shape: tuple[int, int, int], axis: int, at: int, mask: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(grey, shown): the pixels of a slice of the background (i, j, k, value) and those of the signal (r, i, j, k, value) over it.

    mask is a table of the voxels (i, j, k) whose signal counts; without one, signals that aren't zero are shown.
    """
    over = None if mask is None else slice_pixels(mask.select("i", "j", "k", F.lit(1.0).alias("value")), shape, axis, at)
    return slice_pixels(background.select("i", "j", "k", "value"), shape, axis, at), overlay(slice_pixels(foreground, shape, axis, at), over)


def time_curve(mode: DataFrame, rank: int) -> DataFrame:
    """r, t, value, y_low, y_high: a scaled long time mode (t, r, value) with the limits of its plot."""
    scaled = scale_columns(mode, ["r"])
    top = scaled.agg(F.max("value").alias("_top"))
    return scaled.join(F.broadcast(top)).select("r", "t", "value", F.lit(-0.1).alias("y_low"), (1.1 * F.col("_top")).alias("y_high"))  # one row is broadcast


@dataclass
class ModeGrid:
    """All modes of a model, a row for each component: time curve, subject boxes, and a slice of each tissue across the first axis.

    time (t, r, value) and values (l, r, value) are long modes, subjects is a subject_table,
    image has the voxels (i, j, k, value) of the background. pixels are those of the
    tissue's voxels, whatever their value. Each table is made when it is first asked for.
    """

    time: DataFrame
    subjects: DataFrame
    group: str
    values: DataFrame
    index: DataFrame
    image: DataFrame
    shape: tuple[int, int, int]
    at: int
    rank: int

    @cached_property
    def curves(self) -> DataFrame:
        return time_curve(self.time, self.rank)

    @cached_property
    def boxes(self) -> SubjectReport:
        return SubjectReport(self.subjects, self.rank, self.group)

    @cached_property
    def grid(self) -> DataFrame:
        return tissue_grid(self.values, self.index)

    @cached_property
    def background(self) -> DataFrame:
        return slice_pixels(self.image.select("i", "j", "k", "value"), self.shape, 0, self.at)

    @cached_property
    def pixels(self) -> DataFrame:
        return slice_pixels(self.grid, self.shape, 0, self.at)

    @cached_property
    def colours(self) -> DataFrame:
        return colour_limits(self.grid, ["tissue", "r"], "value")
