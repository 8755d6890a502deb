"""The result tables of one variant, with the physical form chosen per input.

``form``:
    "join"   literal operators (stay-days, full outer joins, self-join)
    "sweep"  O(stays) sweep forms; refused when ids repeat (declare them
             unique on the inputs to skip the check)
    "flags"  exact for any input: one explode + group-by on (day, id), and
             the aggregated look-ahead counts
    "union"  exact for any input: per id and side the union of its spans,
             then the sweep; look-ahead as "flags"
    "hybrid" exact for any input: "sweep" for the stays of ids seen once,
             "union" only for the stays of duplicated ids
    "auto"   "sweep" if the ids are unique, else "hybrid"; uniqueness is
             checked once per input with one aggregate over the ids
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedcensus.config import DayWindow, VariantConfig
from bedcensus.operators import adjust as A
from bedcensus.operators import lookahead as L
from bedcensus.operators import occupancy as O
from bedcensus.operators import reports as R
from bedcensus.operators import stays as S
from bedcensus.plans import forms
from bedcensus.sources.layout import MONTH, within

FORMS = ("auto", "join", "sweep", "flags", "union", "hybrid")


def keys_unique(df: DataFrame, cols: list[str]) -> bool:
    """True when no non-null key occurs twice.

    One aggregate over the key columns (partial aggregation first, so a hot
    key costs one row per task), then a look at whether it left any duplicate.
    """
    cond = F.col(cols[0]).isNotNull()
    for c in cols[1:]:
        cond = cond & F.col(c).isNotNull()
    dup = df.select(*cols).where(cond).groupBy(*cols).count().where(F.col("count") > 1).limit(1)
    return dup.count() == 0


@dataclass
class Inputs:
    """Base ``evaluation`` and ``admissions`` plus cached key checks.

    A caller that knows the keys (a primary key in the source schema) can
    declare them with :meth:`declare_unique` and save the check's shuffle.
    """

    ev: DataFrame
    adm: DataFrame
    #: What the folder's layout says (``sources.layout``); with months, a window
    #: reads only those whose stays can touch it.
    layout: dict | None = None
    _unique: dict = field(default_factory=dict)
    _dup: DataFrame | None = None
    _dup_old: DataFrame | None = None
    _lock: threading.RLock = field(default_factory=threading.RLock, repr=False)

    def declare_unique(self, ids: bool = True, admission_keys: bool = True) -> "Inputs":
        self._unique["ev"] = ids
        self._unique["adm"] = admission_keys
        return self

    def ids_unique(self) -> bool:
        """Non-null ``hadm_id`` unique in ``evaluation``.

        The adjustments keep ids and row counts, so this holds for every
        variant's table.
        """
        with self._lock:
            if "ev" not in self._unique:
                self._unique["ev"] = keys_unique(self.ev, ["hadm_id"])
            return self._unique["ev"]

    def duplicate_ids(self) -> DataFrame:
        """Ids seen more than once in ``evaluation``, computed once: the
        adjustments keep ids, so every variant shares the list."""
        with self._lock:
            if self._dup is None:
                self._dup = forms.duplicate_ids(self.ev)
            return self._dup

    def rebased_duplicate_ids(self) -> DataFrame:
        """The same on the old timeline; where admissions keys are unique the
        rebase repeats no row, so the list above serves."""
        self.rebased_ids_unique()
        with self._lock:
            if self._unique["adm"]:
                return self.duplicate_ids()
            if self._dup_old is None:
                self._dup_old = forms.duplicate_ids(S.rebase_admissions(self.ev, self.adm))
            return self._dup_old

    def rebased_ids_unique(self) -> bool:
        """Non-null ``hadm_id`` unique after the rebase join: unique in
        ``evaluation`` and at most one admissions row per join key."""
        with self._lock:
            if "adm" not in self._unique:
                self._unique["adm"] = keys_unique(self.adm, ["subject_id", "hadm_id"])
            return self.ids_unique() and self._unique["adm"]


class Variant:
    """Lazy DataFrames of one variant's result tables."""

    def __init__(
        self,
        inputs: Inputs,
        cfg: VariantConfig,
        form: str = "auto",
        ev: DataFrame | None = None,
        persist: bool = True,
    ):
        if form not in FORMS:
            raise ValueError(f"form must be one of {FORMS}")
        self.inputs = inputs
        self.cfg = cfg
        self.form = form
        self.ev = ev if ev is not None else A.adjust_predictions(inputs.ev, cfg.adjust, cfg.error_threshold)
        #: Stays that can touch the new window.
        self.ev_new = within(self.ev, inputs.layout, cfg.new_window)
        self.persist = persist
        self._memo: dict[str, DataFrame] = {}
        self._split: tuple[DataFrame, DataFrame] | None = None
        # result tables may be built from several driver threads (the job
        # writes them concurrently); shared intermediates are built once
        self._lock = threading.RLock()

    def _once(self, key: str, build, persist: bool = False) -> DataFrame:
        """Build each intermediate once per variant. ``persist`` is used only
        for calendar-sized tables (at most one row per day of the window),
        which several results read; a variant built for a single result
        (``persist=False``) skips it."""
        with self._lock:
            if key not in self._memo:
                df = build()
                if persist and self.persist:
                    df = df.persist(StorageLevel.MEMORY_AND_DISK)
                self._memo[key] = df
            return self._memo[key]

    def unpersist(self) -> None:
        for df in self._memo.values():
            if df.storageLevel != StorageLevel.NONE:
                df.unpersist()

    # -- form choice -------------------------------------------------------
    def _form(self, unique: bool | None) -> str:
        if self.form == "sweep" and not unique:
            raise ValueError("form 'sweep' counts rows, and hadm_id repeats here; use 'hybrid' or 'auto'")
        if self.form != "auto":
            return self.form
        return "sweep" if unique else "hybrid"

    def form_new(self) -> str:
        return self._form(self.inputs.ids_unique() if self.form in ("auto", "sweep") else None)

    def form_old(self) -> str:
        return self._form(self.inputs.rebased_ids_unique() if self.form in ("auto", "sweep") else None)

    # -- stay-days (literal) ------------------------------------------------
    def predicted_new(self) -> DataFrame:
        return self._once("pn", lambda: S.predicted_stay_days(self.ev_new, self.cfg.new_window))

    def actual_new(self) -> DataFrame:
        return self._once("an", lambda: S.actual_stay_days(self.ev_new, self.cfg.new_window))

    def rebased(self) -> DataFrame:
        if "_old_match" in self.ev.columns:
            return self._once("rb", lambda: S.rebased_from_attached(self.ev))
        return self._once("rb", lambda: S.rebase_admissions(self.ev, self.inputs.adm))

    def predicted_old(self) -> DataFrame:
        return self._once("po", lambda: S.predicted_stay_days(self.rebased(), self.cfg.old_predicted_window))

    def actual_old(self) -> DataFrame:
        return self._once("ao", lambda: S.actual_stay_days(self.rebased(), self.cfg.old_actual_window))

    def timeline_new(self) -> DataFrame:
        return self._once("tl", lambda: O.presence_timeline(self.predicted_new(), self.actual_new()))

    # -- per-day sweeps (calendar-sized) --------------------------------------
    def _both_deltas(self) -> DataFrame | None:
        """Per-day changes of both timelines, from one pass, where several
        results share them and the old dates are attached."""
        if not self.persist or "_old_match" not in self.ev.columns or self.form not in ("auto", "sweep"):
            return None
        if not self.inputs.rebased_ids_unique():
            return None
        c = self.cfg
        return self._once(
            "both",
            lambda: forms.two_timeline_deltas(
                self.ev, c.new_window, c.old_predicted_window, c.old_actual_window, c.lookahead_days
            ),
            persist=True,
        )

    def sweep_new(self) -> DataFrame:
        w = self.cfg.new_window
        both = self._both_deltas()
        if both is not None:
            return self._once(
                "sw_new", lambda: forms.daily_from_deltas(both.where("line = 0").drop("line"), w), persist=True
            )
        return self._once(
            "sw_new", lambda: forms.daily_sweep(self.ev_new, w, w, self.cfg.lookahead_days), persist=True
        )

    def sweep_old(self) -> DataFrame:
        pw, aw = self.cfg.old_predicted_window, self.cfg.old_actual_window
        both = self._both_deltas()
        if both is not None:
            cover = DayWindow(min(pw.lo, aw.lo), max(pw.hi, aw.hi))
            return self._once(
                "sw_old", lambda: forms.daily_from_deltas(both.where("line = 1").drop("line"), cover), persist=True
            )
        return self._once("sw_old", lambda: forms.daily_sweep(self.rebased(), pw, aw), persist=True)

    # -- hybrid: ids seen once by sweep, duplicated ids by interval union --------
    def _split_new(self) -> tuple[DataFrame, DataFrame]:
        """(stays of ids seen once or NULL, stays of duplicated ids), built once."""
        with self._lock:
            if self._split is None:
                self._split = forms.split_duplicate_ids(self.ev_new, dup=self.inputs.duplicate_ids())
            return self._split

    def sweep_new_unique_part(self) -> DataFrame:
        w = self.cfg.new_window
        return self._once(
            "sw_new_uni",
            lambda: forms.daily_sweep(self._split_new()[0], w, w, self.cfg.lookahead_days),
            persist=True,
        )

    def union_new(self) -> DataFrame:
        """Counters of the new timeline with every id counted once a day."""
        w = self.cfg.new_window
        if self.form_new() == "hybrid":
            return self._once(
                "un_new",
                lambda: forms.add_daily(self.sweep_new_unique_part(), forms.daily_union(self._split_new()[1], w, w)),
                persist=True,
            )
        return self._once("un_new", lambda: forms.daily_union(self.ev_new, w, w), persist=True)

    def _join_lookahead_parts(self) -> tuple[DataFrame, DataFrame]:
        """Literal chain: ``(time, pn)`` from the offset self-join and
        ``(timeline, n)`` distinct actual ids, both from the presence timeline."""
        tl = self.timeline_new()
        later = L.lookahead_presence(O.presence_flags(tl), self.cfg.lookahead_days, counted=True)
        per_day = L.lookahead_daily(later)
        return per_day, O.daily_actual_distinct(tl)

    # -- results --------------------------------------------------------------
    def los_error(self) -> DataFrame:
        return R.los_error_histogram(self.ev)

    def evaluation(self) -> DataFrame:
        """The variant's six evaluation columns."""
        return self.ev.drop(*S.REBASE_COLUMNS, A.COPY_COLUMN, MONTH)

    def occupancy_new(self) -> DataFrame:
        # a filter over the persisted sweep needs no copy of its own
        return self._once("occ_new", self._occupancy_new, persist=self.form_new() in ("join", "flags"))

    def _occupancy_new(self) -> DataFrame:
        w = self.cfg.new_window
        f = self.form_new()
        if f == "join":
            return O.daily_occupancy(O.align_presence(self.predicted_new(), self.actual_new()))
        if f == "sweep":
            return forms.occupancy_from_sweep(self.sweep_new())
        if f in ("union", "hybrid"):
            return forms.occupancy_from_sweep(self.union_new())
        return forms.daily_occupancy_flags(self.ev_new, w, w)

    def _form_old_table(self) -> str:
        # the per-side row counts (C15) are exact by sweep for any input, so
        # that shape needs no key check
        if self.cfg.old_shape == "by_side":
            return "join" if self.form == "join" else "sweep"
        return self.form_old()

    def occupancy_old(self) -> DataFrame:
        from_sweep = self._form_old_table() == "sweep"
        return self._once("occ_old", self._occupancy_old, persist=not from_sweep)

    def _occupancy_old(self) -> DataFrame:
        pw, aw = self.cfg.old_predicted_window, self.cfg.old_actual_window
        f = self._form_old_table()
        if self.cfg.old_shape == "by_side":
            if f == "join":
                return O.daily_occupancy_by_side(self.predicted_old(), self.actual_old())
            return forms.by_side_from_sweep(self.sweep_old())
        if f == "join":
            return O.daily_occupancy(O.align_presence(self.predicted_old(), self.actual_old()))
        if f == "sweep":
            return forms.occupancy_from_sweep(self.sweep_old())
        if f == "hybrid":
            return forms.daily_occupancy_hybrid(self.rebased(), pw, aw, self.inputs.rebased_duplicate_ids())
        if f == "union":
            return forms.occupancy_from_sweep(forms.daily_union(self.rebased(), pw, aw))
        return forms.daily_occupancy_flags(self.rebased(), pw, aw)

    def occupancy_error_new(self) -> DataFrame:
        return R.occupancy_error_histogram(self.occupancy_new())

    def occupancy_error_old(self) -> DataFrame:
        return R.occupancy_error_histogram(self.occupancy_old())

    def occupancy_error_year(self) -> DataFrame:
        return R.occupancy_error_series(self.occupancy_new(), self.cfg.year)

    def lookahead_per_day(self) -> DataFrame:
        """``(time, pn, n)``: look-ahead matches and actual count per day."""
        return self._once("look", self._lookahead_per_day, persist=self.form_new() != "sweep")

    def _lookahead_per_day(self) -> DataFrame:
        w, lag = self.cfg.new_window, self.cfg.lookahead_days
        f = self.form_new()
        if f == "join":
            per_day, actual = self._join_lookahead_parts()
            return per_day.join(actual, per_day.time == actual.timeline, "inner").select("time", "pn", "n")
        if f == "sweep":
            return forms.lookahead_from_sweep(self.sweep_new())
        if f == "hybrid":
            return forms.combine_daily(
                forms.lookahead_from_sweep(self.sweep_new_unique_part()),
                forms.lookahead_counts_by_id(self._split_new()[1], w, lag),
                "time",
                ["pn", "n"],
            )
        return forms.lookahead_counts_by_id(self.ev_new, w, lag)

    def lookahead_error(self) -> DataFrame:
        if self.form_new() == "join":
            per_day, actual = self._join_lookahead_parts()
            return L.lookahead_error_histogram(per_day, actual, self.cfg.inflow)
        d = self.lookahead_per_day()
        err = (F.col("n") - (F.col("pn") + F.lit(self.cfg.inflow))).cast("bigint").alias("error")
        return R.histogram(d.select(err))

    def daily_actual(self) -> DataFrame:
        """``(timeline, n)`` distinct actual ids per day."""
        f = self.form_new()
        if f in ("join", "flags"):
            return O.daily_actual_distinct(self.timeline_new())
        return forms.daily_actual_from_sweep(self.sweep_new() if f == "sweep" else self.union_new())

    def bed_occupancy_year(self) -> DataFrame:
        """C23. The sweep (unique ids) or the union (any ids) holds the counts;
        the other forms expand stays inside the focus year only."""
        f = self.form_new()
        if f in ("sweep", "union", "hybrid"):
            daily = self.sweep_new() if f == "sweep" else self.union_new()
            return R.numbered_days(daily.where(F.col("a_any") > 0).select("day", F.col("a_cnt").alias("n")), self.cfg.year)
        w, y = self.cfg.new_window, self.cfg.year
        lo, hi = max(w.lo, date(y, 1, 1)), min(w.hi, date(y, 12, 31))
        year = DayWindow(lo, hi)
        return R.bed_occupancy_series(S.actual_stay_days(within(self.ev, self.inputs.layout, year), year), y)

    def occupancy_level_frequency(self) -> DataFrame:
        return R.occupancy_level_frequency(self.occupancy_new())

    def result_builders(self) -> dict[str, Callable[[], DataFrame]]:
        """The five result tables under the original file names, as
        zero-argument builders (so each can be planned in its own thread)."""
        prefix = "" if self.cfg.name == "normal" else f"{self.cfg.name}_"
        return {
            f"{prefix}los_error_diff": self.los_error,
            f"{prefix}occ": self.lookahead_error,
            f"{prefix}occupied_error_diff_new": self.occupancy_error_new,
            f"{prefix}occupied_error_diff_old": self.occupancy_error_old,
            f"{prefix}occupied_error_within_year_new": self.occupancy_error_year,
        }

    def results(self) -> dict[str, DataFrame]:
        """The five result tables under the original file names."""
        return {name: build() for name, build in self.result_builders().items()}
