"""Tracks, virtual tracks and the expressions over them."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.operators import iterators as it
from rangeloom.operators.intervals import canonic
from rangeloom.operators.ranges import BIN, TILE, free_parts, no_nan, overlap_join, running
from rangeloom.storage import stored

#: Columns that tell a window apart: the iterator row's own chromosome, start and end.
KEY = ["_chrom", "_start", "_end"]
#: Functions that give a single bin's value as it is.
_SAME = frozenset(["avg", "sum", "min", "max", "first", "last", "nearest"])
#: Functions whose value for a window follows from those of its parts, and how they are put together (see ``_folded``).
_FOLDED = frozenset(["avg", "sum", "size", "min", "max", "exists", "lse"])
#: Blocks in a block of the next level; levels; bins of a window from which blocks are used.
FOLD, FOLD_LEVELS, FOLD_LEAST = 16, 5, 64
_NAME = re.compile(r"`([^`]+)`|\b([A-Za-z_][\w.]*)\b")


@dataclass(frozen=True)
class Track:
    """A table of values: dense (``chrom, bin, value``; ``bin_size`` set) or sparse (``chrom, start, end, value``)."""

    data: DataFrame
    bin_size: int | None = None

    def records(self, chroms: DataFrame | None = None) -> DataFrame:
        """Rows ``chrom, start, end, value``; a dense track's last bin may pass its chromosome's end."""
        if self.bin_size is None:
            return self.data.select("chrom", "start", "end", no_nan("value").alias("value"))
        start = F.col("bin") * self.bin_size
        return self.data.select("chrom", start.alias("start"), (start + self.bin_size).alias("end"), no_nan("value").alias("value"))


@dataclass(frozen=True)
class VirtualTrack:
    """A window function of a source, evaluated for each iterator row.

    ``source`` is a track's name, an interval table, or None for sequence
    functions.  The window is the row moved by ``sshift`` and ``eshift``, clipped
    to the chromosome; an empty one gives null.  ``mask`` rows are taken out of
    the window.
    """

    source: str | DataFrame | Track
    func: str = "avg"
    params: float | int | None = None
    sshift: int = 0
    eshift: int = 0
    mask: DataFrame | None = None


def _stable(values: Column) -> Column:
    def total(top: Column) -> Column:
        return top + F.log(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.exp(v - top)))

    return F.when(F.size(values) > 0, F.transform(F.array(F.array_max(values)), total)[0])


def _log_sum(value: Column) -> Column:
    return _stable(F.collect_list(value))


def _aggregate(func: str, params) -> Column:
    """The aggregate of a window's records: ``value``, their place ``pos``, the window's start ``wstart``."""
    v, pos = F.col("value"), F.when(F.col("value").isNotNull(), F.col("pos"))
    # a draw by place, so that a window's value and its place agree and reruns do too
    drawn = F.when(v.isNotNull(), F.xxhash64(F.lit(int(params) if isinstance(params, int) else 1), "_chrom", "_start", "pos"))
    places = {
        "sample": lambda: F.max_by("pos", drawn),
        "first": lambda: F.min(pos),
        "last": lambda: F.max(pos),
        "min": lambda: F.min_by("pos", F.when(v.isNotNull(), F.struct(v, "pos"))),
        "max": lambda: F.min_by("pos", F.when(v.isNotNull(), F.struct(-v, "pos"))),
    }
    plain = {
        "avg": lambda: F.avg(v),
        "sum": lambda: F.sum(v),
        "min": lambda: F.min(v),
        "max": lambda: F.max(v),
        "stddev": lambda: F.stddev_samp(v),
        "size": lambda: F.count(v),
        "exists": lambda: F.max((v.isin([float(x) for x in params]) if isinstance(params, (list, tuple)) else v.isNotNull()).cast("int")),
        "first": lambda: F.min_by(v, pos),
        "last": lambda: F.max_by(v, pos),
        "quantile": lambda: F.percentile(v, float(params)),
        "lse": lambda: _stable(F.collect_list(v)),
        "sample": lambda: F.max_by(v, drawn),
        "nearest": lambda: F.avg(v),
    }
    if m := re.fullmatch(r"(first|last|min|max|sample)\.pos\.(abs|relative)", func):
        place = places[m[1]]()
        return place - F.first("wstart") if m[2] == "relative" else place
    if func not in plain:
        raise ValueError(f"unknown window function {func}")
    return plain[func]()


class Workspace:
    """Chromosomes, tracks and virtual tracks under names, and the expressions over them.

    ``chroms`` has (``chrom_id``, ``chrom``, ``size``).  Expressions are Spark SQL
    over the names; a name that SQL wouldn't take stands in back-ticks.  Missing
    values are null.
    """

    def __init__(self, chroms: DataFrame, bin_width: int = BIN, sequence: DataFrame | None = None, sequence_chunk: int = 1 << 20):
        self.chroms, self.bin_width = chroms, bin_width
        self.sequence, self.sequence_chunk = sequence, sequence_chunk
        self.tracks: dict[str, Track] = {}
        self.virtual: dict[str, VirtualTrack] = {}
        self._masks: dict[int, tuple[DataFrame, DataFrame]] = {}

    # names

    def dense(self, name: str, data: DataFrame, bin_size: int) -> None:
        self.tracks[name] = Track(data, bin_size)

    def sparse(self, name: str, data: DataFrame) -> None:
        self.tracks[name] = Track(data)

    def vtrack(self, name: str, source, func: str = "avg", params=None, sshift: int = 0, eshift: int = 0, mask: DataFrame | None = None) -> None:
        self.virtual[name] = VirtualTrack(source, func, params, sshift, eshift, mask)

    def vtrack_iterator(self, name: str, sshift: int = 0, eshift: int = 0) -> None:
        self.virtual[name] = replace(self.virtual[name], sshift=sshift, eshift=eshift)

    def vtrack_filter(self, name: str, mask: DataFrame | None) -> None:
        self.virtual[name] = replace(self.virtual[name], mask=mask)

    def vtrack_ls(self, pattern: str = "") -> list[str]:
        return sorted(x for x in self.virtual if re.search(pattern, x))

    def vtrack_info(self, name: str) -> VirtualTrack:
        return self.virtual[name]

    def vtrack_rm(self, name: str | None = None) -> None:
        """Drop one virtual track, or all."""
        if name is None:
            self.virtual.clear()
        else:
            self.virtual.pop(name, None)

    # iterators

    def scope(self, scope: DataFrame | None = None) -> DataFrame:
        from rangeloom.operators.intervals import all_chroms

        return it.numbered(all_chroms(self.chroms) if scope is None else scope)

    def names_in(self, *exprs: str) -> list[str]:
        found = {a or b for e in exprs for a, b in _NAME.findall(e)}
        return sorted(x for x in found if x in self.tracks or x in self.virtual)

    def iterator(self, scope: DataFrame, iterator: int | str | DataFrame | None, exprs: list[str]) -> DataFrame:
        """Rows of the iterator: bins of a width, rows of a table or track, or what the expressions' tracks imply."""
        if isinstance(iterator, int):
            return it.fixed_bins(scope, iterator)
        if isinstance(iterator, DataFrame):
            return it.over_intervals(scope, iterator, self.bin_width)
        if isinstance(iterator, str):
            track = self.tracks[iterator]
            return it.fixed_bins(scope, track.bin_size) if track.bin_size else it.over_intervals(scope, track.data, self.bin_width)
        used = {n: self._base(n) for n in self.names_in(*exprs)}
        tracks = {n: t for n, t in used.items() if t is not None}
        sizes = {t.bin_size for t in tracks.values()}
        if len(sizes) != 1 or (sizes == {None} and len({id(t) for t in tracks.values()}) != 1):
            raise ValueError("the expressions' tracks imply no single iterator; name one")
        return self.iterator(scope, next(iter(sizes)) or next(iter(tracks.values())).data, exprs)

    def iterator_width(self, iterator: int | str | DataFrame | None, exprs: list[str]) -> int | None:
        """The width of the iterator's bins, None where it is one of intervals."""
        if iterator is None:
            return next((t.bin_size for n in self.names_in(*exprs) if (t := self._base(n)) is not None), None)
        return iterator if isinstance(iterator, int) else self.tracks[iterator].bin_size if isinstance(iterator, str) else None

    def _base(self, name: str) -> Track | None:
        if name in self.tracks:
            return self.tracks[name]
        source = self.virtual[name].source
        return self.tracks[source] if isinstance(source, str) else source if isinstance(source, Track) else None

    # evaluation

    def _mask(self, mask: DataFrame) -> DataFrame:
        """A mask's merged intervals, made once for all names that have it."""
        if id(mask) not in self._masks:
            self._masks[id(mask)] = (mask, stored(canonic(mask), "mask"))
        return self._masks[id(mask)][1]

    def _windows(self, rows: DataFrame, v: VirtualTrack) -> DataFrame:
        """The rows' windows (KEY, ``chrom``, ``start``, ``end``); masked ones in parts."""
        sized = rows.join(self.chroms.select("chrom", "size"), "chrom")
        start = F.greatest(F.col("start") + v.sshift, F.lit(0).cast("long"))
        moved = sized.select(*KEY, "chrom", start.alias("start"), F.least(F.col("end") + v.eshift, "size").alias("end")).where("start < end")
        if v.mask is None:
            return moved
        return free_parts(moved, self._mask(v.mask), self.bin_width)

    def _folded(self, windows: DataFrame, track: Track, wanted: dict[str, VirtualTrack]) -> DataFrame:
        """Wide windows of a dense track, put together from blocks of bins.

        A block of FOLD blocks of the level below holds their count, sum,
        extremes and log-sum-exp.  A window is whole blocks of some level in its
        middle and fewer than FOLD on each side at every level below, so it
        meets at most 2 * FOLD * FOLD_LEVELS rows, however wide it is, and no
        sum is a difference of larger ones.
        """
        b = track.bin_size
        level = track.data.select("chrom", F.col("bin").alias("node"), no_nan("value").alias("s")).where("s IS NOT NULL")
        level = stored(level.select("chrom", "node", F.lit(1).cast("long").alias("n"), "s", F.col("s").alias("lo"), F.col("s").alias("hi"), F.col("s").alias("l")), "fold")
        levels, current = None, level
        for k in range(FOLD_LEVELS):
            tagged = current.withColumn("level", F.lit(k))
            levels = tagged if levels is None else levels.unionByName(tagged)
            grouped = current.groupBy("chrom", F.floor(F.col("node") / FOLD).alias("node"))
            if k + 1 < FOLD_LEVELS:
                current = stored(grouped.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), _log_sum(F.col("l")).alias("l")), "fold")
        spans = windows.select(*KEY, "chrom", F.floor(F.col("start") / b).alias("_a0"), F.ceil(F.col("end") / b).alias("_b0"))
        span = lambda a, e: F.when(a < e, F.sequence(a, e - 1)).otherwise(F.array().cast("array<bigint>"))
        nodes = []
        for k in range(FOLD_LEVELS):
            a, e = F.col(f"_a{k}"), F.col(f"_b{k}")
            if k + 1 < FOLD_LEVELS:
                up, down = F.ceil(a / FOLD), F.floor(e / FOLD)
                inner = up < down
                spans = spans.withColumns({f"_a{k + 1}": F.when(inner, up).otherwise(F.lit(0)), f"_b{k + 1}": F.when(inner, down).otherwise(F.lit(0))})
                here = F.when(inner, F.concat(span(a, up * FOLD), span(down * FOLD, e))).otherwise(span(a, e))
            else:
                here = span(a, e)
            nodes.append(F.struct(F.lit(k).alias("level"), here.alias("nodes")))
        met = spans.select(*KEY, "chrom", F.explode(F.array(*nodes)).alias("x")).select(*KEY, "chrom", F.col("x.level").alias("level"), F.explode("x.nodes").alias("node")).select(*KEY, "chrom", "level", "node").join(levels, ["chrom", "level", "node"])
        kinds = {
            "avg": F.sum("s") / F.sum("n"), "sum": F.sum("s"), "size": F.sum("n"), "min": F.min("lo"), "max": F.max("hi"), "exists": F.max(F.when(F.col("n") > 0, 1)), "lse": _log_sum(F.col("l")),
        }
        made = met.groupBy(*KEY).agg(*(kinds[w.func].alias(n) for n, w in wanted.items()))
        counts = [n for n, w in wanted.items() if w.func in ("exists", "size")]
        return windows.select(*KEY).distinct().join(made, KEY, "left").fillna(0, counts) if counts else made

    def _of_track(self, rows: DataFrame, track: Track, wanted: dict[str, VirtualTrack], width: int | None = None) -> DataFrame:
        """A column for each of ``wanted``, whose source, shifts and mask are one: a join and an aggregation for all of them.

        ``width`` is the iterator's, where it is one of bins; wide windows of a dense track go by blocks.
        """
        v = next(iter(wanted.values()))
        windows = self._windows(rows, v)
        if track.bin_size and width and v.mask is None and width + v.eshift - v.sshift > FOLD_LEAST * track.bin_size:
            fold = {n: w for n, w in wanted.items() if w.func in _FOLDED and not (w.func == "exists" and w.params)}
            if fold:
                made = self._folded(windows, track, fold)
                rest = {n: w for n, w in wanted.items() if n not in fold}
                return made.join(self._of_track(rows, track, rest), KEY, "full") if rest else made
        if track.bin_size:
            # a bin that a window touches counts in full: an equi-join on (chrom, bin)
            b = track.bin_size
            touched = windows.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / b), F.ceil(F.col("end") / b) - 1)))
            found = touched.join(track.data.select("chrom", "bin", no_nan("value").alias("value")), ["chrom", "bin"])
            found = found.select(*KEY, "start", "end", "value", F.greatest(F.col("bin") * b, "start").alias("pos"))
        else:
            found = overlap_join(windows, track.records(), self.bin_width)
            found = found.select(*KEY, "start", "end", "value", F.greatest("start1", "start").alias("pos"))
        found = found.withColumn("wstart", F.col("_start") + v.sshift)
        masked = {n: w for n, w in wanted.items() if v.mask is not None and w.func in ("avg", "stddev")}
        plain = {n: w for n, w in wanted.items() if n not in masked}
        made = None
        if plain:
            kind = lambda w: w.func.removeprefix("global.percentile").removeprefix(".") or "avg" if w.func.startswith("global.percentile") else w.func
            made = found.groupBy(*KEY).agg(*(_aggregate(kind(w), w.params).alias(n) for n, w in plain.items()))
        if masked:
            # a window in parts: their means and variances weigh as much as they are long
            parts = found.groupBy(*KEY, "start", "end").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
            n, m, s = (F.col("end") - F.col("start")).cast("double"), F.col("m"), F.col("s")
            both = F.when(s.isNotNull(), n)
            mean = F.sum(both * m) / F.sum(both)
            spread = F.sum(both * (s * s + m * m)) / F.sum(both) - mean * mean
            kinds = {"avg": F.sum(F.when(m.isNotNull(), n * m)) / F.sum(F.when(m.isNotNull(), n)), "stddev": F.sqrt(F.greatest(spread, F.lit(0.0)))}
            part = parts.groupBy(*KEY).agg(*(kinds[w.func].alias(x) for x, w in masked.items()))
            made = part if made is None else made.join(part, KEY, "full")
        for n, w in wanted.items():
            if w.func.startswith("global.percentile"):
                made = self._percentiles(made, track, n)
            if w.func == "nearest" and not track.bin_size:
                from rangeloom.operators.nearest import neighbors

                empty = windows.join(made.where(F.col(n).isNotNull()).select(*KEY), KEY, "left_anti")
                close = neighbors(empty, track.records(), 1).select(*KEY, F.col("value1").alias("_near"))
                made = made.join(close, KEY, "full").withColumn(n, F.coalesce(n, "_near")).drop("_near")
        counts = [n for n, w in wanted.items() if w.func in ("exists", "size")]
        if counts:
            made = windows.select(*KEY).distinct().join(made, KEY, "left").fillna(0, counts)
        return made

    @staticmethod
    def _percentiles(made: DataFrame, track: Track, name: str) -> DataFrame:
        """Each value's share of the track's values that are no larger: exact, from counts of distinct values and their ranks."""
        from rangeloom.operators.aggregates import cumulative

        known = cumulative(track.records().where("value IS NOT NULL"), "value")
        asked = made.where(F.col(name).isNotNull()).select(F.col(name).alias("value")).distinct().withColumn("c", F.lit(0).cast("long"))
        total = known.agg(F.sum("c").alias("_n"))
        ranked = cumulative(known.select("value", "c").unionByName(asked), "value", "c")
        share = ranked.join(F.broadcast(total), F.lit(True)).select(F.col("value").alias(name), ((F.col("before") + F.col("c")) / F.col("_n")).alias("_p"))
        return made.join(share, name, "left").drop(name).withColumnRenamed("_p", name)

    @staticmethod
    def _wide(v: VirtualTrack) -> int:
        """Letters that a sequence function looks at beyond its window."""
        from rangeloom.functions import sequence as seq

        options = v.params if isinstance(v.params, dict) else {}
        motif, kmer = v.params if isinstance(v.params, seq.Motif) else options.get("motif"), v.params if isinstance(v.params, str) else options.get("kmer")
        return (len(motif.matrix) if motif else len(kmer) if kmer else 1) - 1 if options.get("extend", True) else 0

    def _of_sequence(self, rows: DataFrame, wanted: dict[str, VirtualTrack]) -> DataFrame:
        """``pwm*``, ``kmer.*`` and ``masked.*`` of the windows' sequences; a motif or k-mer may begin anywhere in its window.

        A column for each of ``wanted``, whose shifts, mask and reach are one, so
        that sequences are cut out once.  With a mask, motifs and k-mers begin in
        what it leaves and, unless the option ``extend`` is false, may reach into
        it.  The parts of a window are joined by function: counts add up,
        fractions weigh as much as their part is long, the best score and the
        fewest edits win, a place is the best part's, counted from the window's
        start.  Log-sum-exp scores add up (the option ``parts`` as ``lse`` joins
        them as one scan would).  A window that is masked as a whole is null.
        """
        from rangeloom.sources.formats import extract_sequence

        if self.sequence is None:
            raise ValueError("sequence functions need the workspace's sequence table")
        v = next(iter(wanted.values()))
        windows = self._windows(rows, v).withColumn("_n", F.col("end") - F.col("start")).withColumn("_part", F.col("start"))
        longer = windows.join(self.chroms.select("chrom", "size"), "chrom").withColumn("end", F.least(F.col("end") + self._wide(v), "size")).drop("size")
        cut = extract_sequence(self.sequence, longer, self.sequence_chunk)
        kinds = {name: self._sequence_function(w) for name, w in wanted.items()}
        if v.mask is None:
            return cut.select(*KEY, *(made[0].alias(name) for name, made in kinds.items()))
        parts = cut.select(*KEY, "_part", "_n", *(c.alias(f"{name}{i}") for name, made in kinds.items() for i, c in enumerate(made)))
        return parts.groupBy(*KEY).agg(*(self._joined(w, name).alias(name) for name, w in wanted.items()))

    @staticmethod
    def _sequence_function(v: VirtualTrack) -> list[Column]:
        """The value of a part's sequence, and what tells the best of several parts."""
        from rangeloom.functions import motif_edits as edits
        from rangeloom.functions import sequence as seq

        options = dict(v.params) if isinstance(v.params, dict) else {}
        motif, kmer = (v.params if isinstance(v.params, seq.Motif) else options.pop("motif", None)), (v.params if isinstance(v.params, str) else options.pop("kmer", None))
        strand = options.pop("strand", 1 if motif else 0)
        options = {k: x for k, x in options.items() if k not in ("extend", "parts")}
        s = F.col("seq")
        scored = lambda mode, **more: seq.pwm(s, motif, mode, strand=strand, **more, **options)
        kinds = {
            "pwm": lambda: [scored("lse", **{} if "neutral" in options else {"neutral": "forward_quarter"})], "pwm.max": lambda: [scored("max")], "pwm.max.pos": lambda: [scored("pos"), scored("max")],
            "pwm.count": lambda: [scored("count")],
            "kmer.count": lambda: [seq.kmer_count(s, kmer, strand, **options)], "kmer.frac": lambda: [seq.kmer_frac(s, kmer, strand, **options)],
            "masked.count": lambda: [seq.masked_count(s)], "masked.frac": lambda: [seq.masked_frac(s)],
        }
        if v.func.removeprefix("pwm.") in edits.KINDS:
            kind, target = v.func.removeprefix("pwm."), edits.Edits(motif, strand=strand, **options)
            return [edits.measure(s, kind, target, i) for i in range(2 if kind.endswith(".pos") or kind == "max.edit_distance" else 1)]
        if v.func not in kinds:
            raise ValueError(f"unknown window function {v.func}")
        return kinds[v.func]()

    @staticmethod
    def _joined(v: VirtualTrack, name: str) -> Column:
        """The aggregate of a masked window's parts, ``_part`` and ``_n`` their starts and lengths."""
        value = F.col(f"{name}0")
        n = F.when(value.isNotNull(), F.col("_n"))
        parts = v.params.get("parts", "sum") if isinstance(v.params, dict) else "sum"
        if parts not in ("sum", "lse"):
            raise ValueError("parts of a masked window are joined by sum or lse")
        if v.func == "pwm":
            return F.sum(value) if parts == "sum" else _log_sum(value)
        if v.func.endswith(".pos"):
            place = value + F.signum(value) * (F.col("_part") - F.greatest(F.col("_start") + v.sshift, F.lit(0)))
            # of the best score, or of the fewest edits, the first part's
            best = F.col(f"{name}1") if v.func == "pwm.max.pos" else -F.col(f"{name}1")
            return F.max_by(place, F.when(value.isNotNull(), F.struct(best, -F.col("_part"))))
        if v.func == "pwm.max.edit_distance":
            return F.max_by(value, F.when(F.col(f"{name}1").isNotNull(), F.struct(F.col(f"{name}1"), -F.col("_part"))))
        if v.func in ("kmer.frac", "masked.frac"):
            return F.sum(value * n) / F.sum(n)
        return {"pwm.max": F.max, "pwm.n_mutations": F.max, "pwm.edit_distance": F.min, "pwm.edit_distance.lse": F.min}.get(v.func, F.sum)(value)

    def _of_intervals(self, rows: DataFrame, source: DataFrame, v: VirtualTrack) -> DataFrame:
        """``coverage`` and ``neighbor.count`` of what a mask leaves of the windows; distances, which no mask changes."""
        if v.func.startswith("distance"):
            return self._distances(self._windows(rows, replace(v, mask=None)), source, v)
        windows = self._windows(rows, v)
        if v.func == "coverage":
            hit = overlap_join(windows, canonic(source), self.bin_width)
            part = hit.groupBy(*KEY).agg(F.sum(F.least("end", "end1") - F.greatest("start", "start1")).alias("c"))
            size = windows.groupBy(*KEY).agg(F.sum(F.col("end") - F.col("start")).alias("n"))
            return size.join(part, KEY, "left").select(*KEY, (F.coalesce("c", F.lit(0)) / F.col("n")).alias("v"))
        if v.func == "neighbor.count":
            wide = source.select("chrom", (F.col("start") - int(v.params or 0)).alias("start"), (F.col("end") + int(v.params or 0)).alias("end"))
            if v.mask is None:
                hit = overlap_join(windows, wide, self.bin_width).groupBy(*KEY).agg(F.count("*").alias("c"))
            else:
                # an interval that several parts of a window meet counts once
                met = overlap_join(windows, stored(wide.withColumn("_i", F.monotonically_increasing_id()), "wide"), self.bin_width)
                hit = met.select(*KEY, "_i").distinct().groupBy(*KEY).agg(F.count("*").alias("c"))
            return windows.select(*KEY).distinct().join(hit, KEY, "left").select(*KEY, F.coalesce("c", F.lit(0)).alias("v"))
        raise ValueError(f"unknown window function {v.func}")

    def _distances(self, windows: DataFrame, source: DataFrame, v: VirtualTrack) -> DataFrame:
        """``distance`` and ``distance.center`` of the windows' centres, ``distance.edge`` of the windows.

        ``distance`` is measured from the centre to the nearer edge of the
        nearest interval.  Half of its parameter is a margin: inside an interval
        the place between its edges scales from minus to plus the margin, and
        outside it is what lies beyond.  Signs follow the interval's strand; without one, distances are absolute.
        """
        from rangeloom.operators.nearest import neighbors

        source = source.select("chrom", "start", "end", (F.coalesce("strand", F.lit(0)) if "strand" in source.columns else F.lit(0)).cast("int").alias("strand"))
        if v.func == "distance.edge":
            return neighbors(windows, source, 1).select(*KEY, F.col("dist").cast("double").alias("v"))
        centre = F.floor((F.col("start") + F.col("end")) / 2)
        points = windows.select(*KEY, "chrom", centre.alias("start"), (centre + 1).alias("end"))
        at, way = F.col("start"), F.col("strand1")
        if v.func == "distance.center":
            hit = overlap_join(points, source.withColumnRenamed("strand", "strand1"), self.bin_width)
            d = at - F.floor((F.col("start1") + F.col("end1")) / 2)
            d = F.when(way == 1, d).when(way == -1, -d).otherwise(F.abs(d))
            return hit.withColumn("d", d).groupBy(*KEY).agg(F.min_by("d", F.struct(F.abs("d"), F.col("d"))).cast("double").alias("v"))
        if v.func != "distance":
            raise ValueError(f"unknown window function {v.func}")
        margin = float(v.params or 0) / 2
        if margin < 0:
            raise ValueError("the parameter of distance must not be negative")
        if margin and source.count() != canonic(source, touching=False).count():
            raise ValueError("intervals of a distance with a margin must not overlap")
        near = neighbors(points, source, 1)
        sign = F.when(way == 1, -1).otherwise(1)
        left, right = (F.col("start1") - at) * sign, (F.col("end1") - at) * sign
        offset = sign * margin
        inside = (at >= F.col("start1")) & (at < F.col("end1"))
        outer = F.when(F.abs(left) <= F.abs(right), left + offset).otherwise(right - offset)
        d = F.when(inside, margin * (left + right) / (F.col("end1") - F.col("start1")) if margin else F.lit(0.0)).otherwise(outer)
        return near.select(*KEY, F.when(way != 0, d).otherwise(F.abs(d)).cast("double").alias("v"))

    def values(self, rows: DataFrame, name: str) -> DataFrame:
        """``KEY`` and ``v``: a named track's value for each keyed row."""
        v = self.virtual.get(name) or VirtualTrack(name)
        source = self.tracks[v.source] if isinstance(v.source, str) else v.source
        if isinstance(source, Track):
            return self._of_track(rows, source, {"v": v})
        return self._of_sequence(rows, {"v": v}) if source is None else self._of_intervals(rows, source, v)

    def evaluate(self, exprs: dict[str, str], scope: DataFrame | None = None, iterator=None) -> DataFrame:
        """Iterator rows with a column for each expression: ``chrom, start, end, intervalID, ...``.

        Each name is evaluated once, however often it stands in the expressions.
        Names with one source, shifts and mask share a join and an aggregation
        over the distinct windows, which are joined back by their columns.  A
        dense track's own value on bins that don't cross its own is an equi-join
        without any grouping.
        """
        names = self.names_in(*exprs.values())
        rows = self.iterator(self.scope(scope), iterator, list(exprs.values()))
        width = self.iterator_width(iterator, list(exprs.values()))
        groups: dict[tuple, dict[str, VirtualTrack]] = {}
        own: list[str] = []
        for name in names:
            v = self.virtual.get(name) or VirtualTrack(name)
            source = self.tracks[v.source] if isinstance(v.source, str) else v.source
            whole = isinstance(source, Track) and source.bin_size and width and source.bin_size % width == 0
            if whole and v.func in _SAME and not v.sshift and not v.eshift and v.mask is None:
                own.append(name)
            else:
                alone = None if isinstance(source, Track) else self._wide(v) if source is None else name
                groups.setdefault((id(source), v.sshift, v.eshift, id(v.mask), alone), {})[name] = v
        out, column = rows, {name: f"_v{i}" for i, name in enumerate(names)}
        for size in sorted({self._base(n).bin_size for n in own}):
            out = out.withColumn("_bin", F.floor(F.col("start") / size))
            for name in own:
                track = self._base(name)
                if track.bin_size == size:
                    out = out.join(track.data.select("chrom", F.col("bin").alias("_bin"), no_nan("value").alias(column[name])), ["chrom", "_bin"], "left")
            out = out.drop("_bin")
        if groups:
            out = out.withColumns({"_start": F.col("start"), "_end": F.col("end")})
            windows = rows.select("chrom", "start", "end", F.col("chrom").alias("_chrom"), F.col("start").alias("_start"), F.col("end").alias("_end")).distinct()
            for wanted in groups.values():
                first, v = next(iter(wanted.items()))
                source = self.tracks[v.source] if isinstance(v.source, str) else v.source
                if isinstance(source, Track):
                    made = self._of_track(windows, source, {column[n]: w for n, w in wanted.items()}, width)
                elif source is None:
                    made = self._of_sequence(windows, {column[n]: w for n, w in wanted.items()})
                else:
                    made = self.values(windows, first).withColumnRenamed("v", column[first])
                out = out.join(made.withColumnRenamed("_chrom", "chrom"), ["chrom", "_start", "_end"], "left")
        text = {k: _NAME.sub(lambda m: f"`{column[m[1] or m[2]]}`" if (m[1] or m[2]) in column else m[0], e) for k, e in exprs.items()}
        return out.select(*it.COLUMNS, *(F.expr(e).alias(k) for k, e in text.items()))


def create_dense(data: DataFrame, chroms: DataFrame, bin_size: int, func: str = "weighted.mean", default: float | None = None) -> DataFrame:
    """Dense bins (``chrom, bin, value``) from intervals with values.

    ``func``: weighted.mean (by overlap), weighted.sum (value times overlap),
    max, min, median (overlap-weighted, lower), count or coverage (share of the
    bin that is covered).  Bins that nothing covers get ``default``, or are left out.
    """
    b = bin_size
    spread = data.select("chrom", "start", "end", no_nan("value").alias("value")).where("value IS NOT NULL")
    spread = spread.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / b), F.ceil(F.col("end") / b) - 1)))
    part = (F.least("end", (F.col("bin") + 1) * b) - F.greatest("start", F.col("bin") * b)).cast("double")
    spread = spread.withColumn("w", part)
    v, w = F.col("value"), F.col("w")
    if func == "median":
        pairs = F.sort_array(F.collect_list(F.struct("value", "w")))
        start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("m"))
        step = lambda acc, x: F.struct((acc["s"] + x["w"]).alias("s"), F.when(acc["m"].isNull() & (acc["s"] + x["w"] >= F.col("half")), x["value"]).otherwise(acc["m"]).alias("m"))
        made = spread.groupBy("chrom", "bin").agg(pairs.alias("pairs")).withColumn("half", F.aggregate("pairs", F.lit(0.0), lambda s, x: s + x["w"]) / 2)
        made = made.select("chrom", "bin", F.aggregate("pairs", start, step)["m"].alias("value"))
    elif func == "coverage":
        inside = canonic(data).withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / b), F.ceil(F.col("end") / b) - 1)))
        covered = F.sum(F.least("end", (F.col("bin") + 1) * b) - F.greatest("start", F.col("bin") * b))
        made = inside.groupBy("chrom", "bin").agg((covered / b).alias("value"))
    else:
        kinds = {"weighted.mean": F.sum(v * w) / F.sum(w), "weighted.sum": F.sum(v * w), "max": F.max(v), "min": F.min(v), "count": F.count(v).cast("double")}
        made = spread.groupBy("chrom", "bin").agg(kinds[func].alias("value"))
    if default is None:
        return made
    grid = chroms.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / b) - 1)).alias("bin"))
    return grid.join(made, ["chrom", "bin"], "left").withColumn("value", F.coalesce("value", F.lit(default)))


def create_sparse(data: DataFrame, tile: int = TILE) -> DataFrame:
    """Sparse records; overlapping ones are an error."""
    reach = running(data, "max", F.col("end"), "_reach", [F.col("start"), F.col("end")], tile)
    bad = F.raise_error(F.concat(F.lit("overlapping record at "), F.col("start").cast("string"))).cast("long")
    return reach.withColumn("start", F.when(F.col("_reach") > F.col("start"), bad).otherwise(F.col("start"))).drop("_reach")


def smooth(dense: DataFrame, bin_size: int, window: int, algorithm: str = "LINEAR_RAMP", weight_threshold: float = 0.0, smooth_missing: bool = False, tile: int = TILE) -> DataFrame:
    """Smooth a dense track over ``window`` positions: a mean, or a ramp with the centre's weight highest.

    k = int(window / bin / 2 + 0.5) bins on each side; a ramp weighs k + 1 at the
    centre and one less for each bin from it.  Missing bins weigh nothing, and
    give nothing unless ``smooth_missing``.  A result needs total weight above
    ``weight_threshold``.  Each bin is sent to the k bins on either side and
    summed there, an aggregation with map-side combination.
    """
    k = int(0.5 * window / bin_size + 0.5)
    weight = (k + 1 - F.abs("_o")) if algorithm == "LINEAR_RAMP" else F.lit(1)
    rows = dense.select("chrom", "bin", no_nan("value").alias("value")).where("value IS NOT NULL")
    sent = rows.withColumn("_o", F.explode(F.sequence(F.lit(-k), F.lit(k)))).withColumn("_w", weight.cast("double"))
    total = sent.groupBy("chrom", (F.col("bin") + F.col("_o")).alias("bin")).agg(
        F.sum(F.col("value") * F.col("_w")).alias("s"), F.sum("_w").alias("w"), F.max(F.when(F.col("_o") == 0, 1)).alias("own")
    )
    kept = total.where((F.col("w") > weight_threshold) & (F.lit(smooth_missing) | F.col("own").isNotNull()) & (F.col("bin") >= 0))
    return kept.select("chrom", "bin", (F.col("s") / F.col("w")).alias("value"))


def modify(dense: DataFrame, changes: DataFrame) -> DataFrame:
    """A dense track with the bins of ``changes`` (``chrom, bin, value``) put in the place of its own."""
    new = changes.select("chrom", "bin", F.col("value").alias("_new"), F.lit(True).alias("_has"))
    joined = dense.join(new, ["chrom", "bin"], "full")
    return joined.select("chrom", "bin", F.when(F.col("_has"), F.col("_new")).otherwise(F.col("value")).alias("value"))


def mapped_reads(reads: DataFrame, chroms: DataFrame, pileup: int = 0, bin_size: int = 50, remove_duplicates: bool = True) -> DataFrame:
    """Coverage of reads (``chrom, pos, strand, length``): sparse points, or with ``pileup`` a dense average of extended reads."""
    start = F.when(F.col("strand") == -1, F.col("pos") + F.col("length") - 1).otherwise(F.col("pos"))
    ends = reads.withColumn("at", start.cast("long"))
    if remove_duplicates:
        ends = ends.dropDuplicates(["chrom", "at", "strand"])
    if not pileup:
        return ends.groupBy("chrom", F.col("at").alias("start")).agg(F.count("*").cast("double").alias("value")).select("chrom", "start", (F.col("start") + 1).alias("end"), "value")
    low = F.when(F.col("strand") == -1, F.col("at") - pileup + 1).otherwise(F.col("at"))
    spans = ends.select("chrom", low.alias("start"), (low + pileup).alias("end"), F.lit(1.0).alias("value"))
    from rangeloom.operators.intervals import force_range

    total = create_dense(force_range(spans, chroms), chroms, bin_size, "weighted.sum")
    return total.withColumn("value", F.col("value") / bin_size)


def merge_arrays(sources: list[tuple[DataFrame, list[str]]]) -> tuple[DataFrame, list[str]]:
    """One array track of several (``chrom, start, end, value`` arrays, with the names of their elements), and its names.

    It has all columns, in the order of their first source; columns of one name
    are one column.  Records of one place are one record; columns that none of
    its sources has are missing there, and records that miss all are left out.
    Two sources that give one place and column different values are an error
    (``ValueError``), a missing one against a value included, and so are records
    that overlap without being equal, or that repeat within a source.

    All sources are stacked and grouped by place once, however many there are.
    """
    names = list(dict.fromkeys(n for _, columns in sources for n in columns))
    stacked = None
    for i, (data, columns) in enumerate(sources):
        if len(set(columns)) != len(columns):
            raise ValueError("columns of an array track have names of their own")
        values = [no_nan(F.get("value", F.lit(columns.index(n)))) if n in columns else F.lit(None).cast("double") for n in names]
        has = [F.lit(n in columns).cast("int") for n in names]
        one = data.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit(i).alias("_source"), F.array(*values).alias("_v"), F.array(*has).alias("_has"))
        stacked = one if stacked is None else stacked.unionByName(one)
    if stacked is None:
        raise ValueError("an array track needs a source")
    parts = []
    for k in range(len(names)):
        v, has = F.get("_v", F.lit(k)), F.get("_has", F.lit(k))
        given, known = F.sum(has), F.count(v)
        clash = (given > 1) & (((known > 0) & (known < given)) | (F.min(v) != F.max(v)))
        parts += [F.max(v).alias(f"_c{k}"), clash.alias(f"_x{k}")]
    placed = stacked.groupBy("chrom", "start", "end").agg((F.count("*") != F.count_distinct("_source")).alias("_twice"), *parts)
    placed = stored(placed, "arrays")
    bad = placed.where(F.col("_twice") | F.array_max(F.array(F.lit(False), *(F.coalesce(f"_x{k}", F.lit(False)) for k in range(len(names)))))).take(1)
    if bad:
        wrong = [n for k, n in enumerate(names) if bad[0][f"_x{k}"]]
        place = f"{bad[0].chrom}:{bad[0].start}-{bad[0].end}"
        raise ValueError(f"sources differ in {', '.join(wrong)} at {place}" if wrong else f"a source repeats {place}")
    reach = running(placed.select("chrom", "start", "end"), "max", F.col("end"), "_reach", [F.col("start"), F.col("end")])
    crossed = reach.where("start < _reach").take(1)
    if crossed:
        raise ValueError(f"records overlap at {crossed[0].chrom}:{crossed[0].start}-{crossed[0].end}")
    kept = placed.where(F.coalesce(*(F.col(f"_c{k}") for k in range(len(names)))).isNotNull()) if names else placed.limit(0)
    return kept.select("chrom", "start", "end", F.array(*(F.col(f"_c{k}") for k in range(len(names)))).alias("value")), names


def array_slice(track: DataFrame, names: list[str], columns: list[str] | None = None, func: str = "avg", param: float | None = None) -> DataFrame:
    """One value from chosen columns of an array track: avg, min, max, stddev, sum or quantile."""
    at = [names.index(c) for c in columns] if columns else list(range(len(names)))
    values = F.filter(F.array(*(no_nan(F.get("value", F.lit(i))) for i in at)), lambda x: x.isNotNull())
    total, n = F.aggregate(values, F.lit(0.0), lambda s, x: s + x), F.size(values)
    mean = total / n
    spread = F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))

    def quantile() -> Column:
        ordered, place = F.sort_array(values), (n - 1) * float(param)
        low, high = F.get(ordered, F.floor(place).cast("int")), F.get(ordered, F.ceil(place).cast("int"))
        return low + (high - low) * (place - F.floor(place))

    made = {"avg": mean, "sum": total, "min": F.array_min(values), "max": F.array_max(values), "stddev": F.when(n > 1, F.sqrt(spread / (n - 1))), "quantile": quantile() if param is not None else None}[func]
    return track.withColumn("value", F.when(n > 0, made))


def array_extract(track: DataFrame, names: list[str], scope: DataFrame, columns: list[str] | None = None, bin_width: int = BIN) -> DataFrame:
    """Rows of an array track that meet the scope, clipped to it, a column for each chosen name, and ``intervalID``."""
    found = overlap_join(track, it.numbered(scope).select(*it.COLUMNS), bin_width)
    picked = [no_nan(F.get("value", F.lit(names.index(c)))).alias(c) for c in columns or names]
    return found.select("chrom", F.greatest("start", "start1").alias("start"), F.least("end", "end1").alias("end"), *picked, "intervalID")

