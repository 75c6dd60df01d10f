"""Pluggable scorers: a registry, and a map that keeps every failure."""

from __future__ import annotations

import multiprocessing
import random
import time
from collections.abc import Callable, Iterator
from multiprocessing import connection
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import record_seed
from ..storage import importable


class Scorer(Protocol):
    """``load`` runs once in each worker; ``score`` gives probabilities for a batch, or
    raises. Scores outside [0, 1] are failures."""

    def load(self) -> None: ...

    def score(self, batch: pd.DataFrame) -> np.ndarray: ...


REGISTRY: dict[str, Callable[..., Scorer]] = {}


def register(name: str):
    def add(factory: Callable[..., Scorer]) -> Callable[..., Scorer]:
        REGISTRY[name] = factory
        return factory

    return add


def build(name: str, **options) -> Scorer:
    if name not in REGISTRY:
        raise KeyError(f"no scorer {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name](**options)


@register("text_shape")
class TextShapeScorer:
    """A small deterministic scorer for tests: the share of symbols and digits in a text."""

    def __init__(self, column: str = "text"):
        self.column = column

    def load(self) -> None:
        pass

    def score(self, batch: pd.DataFrame) -> np.ndarray:
        def share(t: str) -> float:
            return sum(not (c.isalpha() or c.isspace()) for c in t) / len(t)

        return np.array([share(t) for t in batch[self.column]])


@register("slow_or_broken")
class SlowOrBrokenScorer:
    """For tests of isolation: rows with ``k`` 3 never end and rows with ``k`` 4 have no input."""

    def load(self) -> None:
        pass

    def read(self, row: pd.DataFrame) -> pd.DataFrame:
        if (row["k"] == 4).any():
            raise OSError("no input")
        return row

    def score(self, batch: pd.DataFrame) -> np.ndarray:
        while (batch["k"] == 3).any():
            time.sleep(0.1)
        return np.full(len(batch), 0.5)


def _scored(batches: Iterator[pd.DataFrame], make: Callable[[], Scorer], key: str) -> Iterator[pd.DataFrame]:
    scorer = make()
    scorer.load()

    def rows(part: pd.DataFrame) -> pd.DataFrame:
        p = np.asarray(scorer.score(part), dtype=float)
        if p.shape != (len(part),):
            raise ValueError("a scorer gives one probability for each row")
        ok = np.isfinite(p) & (p >= 0) & (p <= 1)
        return pd.DataFrame({key: part[key], "prob": np.where(ok, p, np.nan), "stage": np.where(ok, None, "inference"), "error": np.where(ok, None, "probability is not a finite number in [0, 1]")})

    for batch in batches:
        try:
            yield rows(batch)
        except Exception:  # a batch that fails is scored row by row, so that one row costs no other
            parts = []
            for i in range(len(batch)):
                try:
                    parts.append(rows(batch.iloc[i : i + 1]))
                except Exception as e:
                    parts.append(pd.DataFrame({key: batch[key].iloc[i : i + 1], "prob": [np.nan], "stage": ["inference"], "error": [f"{type(e).__name__}: {e}"]}))
            yield pd.concat(parts) if parts else pd.DataFrame({key: [], "prob": [], "stage": [], "error": []})


def score_rows(rows: DataFrame, scorer: str, key: str, key_type: str = "long", **options) -> DataFrame:
    """``(key, prob, stage, error)`` of every row: a probability, or the stage and the error."""
    importable(rows.sparkSession)
    factory = REGISTRY[scorer]
    out = rows.mapInPandas(lambda b: _scored(b, lambda: factory(**options), key), f"{key} {key_type}, prob double, stage string, error string")
    return out.selectExpr(key, "nanvl(prob, null) as prob", "stage", "error")


SEED_PREFIX = "260905:"
ISOLATED = "prob double, outcome string, error_type string, error string"


def entry_seed(key: Column) -> Column:
    """The random seed of a record, from its id alone."""
    return record_seed(F.concat(F.lit(SEED_PREFIX), key.cast("string")))


def timeout_error(seconds: float) -> str:
    return f"isolated worker exceeded fixed {seconds:g}-second wall-clock limit"


def _one_record(pipe, make: Callable[[], Scorer], row: pd.DataFrame, seed: int) -> None:
    """What a worker process does: read the input, then score it, and say which of the two failed."""
    random.seed(seed)
    np.random.seed(seed % 2**32)
    stage = "input_execution_error"
    try:
        scorer = make()
        scorer.load()
        if hasattr(scorer, "read"):
            row = scorer.read(row)
        stage = "model_execution_error"
        (p,) = np.asarray(scorer.score(row), dtype=float)
        if not (np.isfinite(p) and 0 <= p <= 1):
            raise ValueError("probability is not a finite number in [0, 1]")
        pipe.send((float(p), "scored", None, None))
    except Exception as e:
        pipe.send((None, stage, type(e).__name__, str(e)))
    finally:
        pipe.close()


#: Processes that a task has at once: waiting for the time limit takes no processor.
ISOLATED_AT_ONCE = 32
#: Seconds after which a worker that has not answered is looked at again.
_LOOK = 0.05


class _Worker:
    """One record in a process of its own, with a wall-clock limit."""

    def __init__(self, make: Callable[[], Scorer], row: pd.DataFrame, seed: int, seconds: float):
        self.seconds = seconds
        fork = multiprocessing.get_context("fork")
        self.pipe, there = fork.Pipe(duplex=False)
        self.process = fork.Process(target=_one_record, args=(there, make, row, seed), daemon=True)
        self.process.start()
        there.close()
        self.until, self.ticks = time.monotonic() + seconds, 0

    def computing(self) -> bool:
        """Whether it uses, or wants, a processor since the last look; where that cannot be seen it is taken to."""
        try:
            with open(f"/proc/{self.process.pid}/stat") as f:
                state, *fields = f.read().rpartition(")")[2].split()
        except OSError:
            return True
        before, self.ticks = self.ticks, int(fields[10]) + int(fields[11])
        return state in "RD" or self.ticks - before > 2

    def result(self) -> tuple:
        """To be asked for when the pipe is ready or the time is over; ends the process."""
        try:
            if not self.pipe.poll(0):
                return None, "model_execution_error", "TimeoutExpired", timeout_error(self.seconds)
            return self.pipe.recv()
        except EOFError:
            return None, "model_execution_error", "WorkerDied", "the worker ended without a result"
        finally:
            self.end()

    def end(self) -> None:
        if self.process.is_alive():
            self.process.kill()
        self.process.join()
        self.process.close()
        self.pipe.close()


def _all_isolated(make: Callable[[], Scorer], rows: list[tuple[pd.DataFrame, int]], seconds: float, at_once: int) -> list[tuple]:
    """Results in the order of ``rows``. A worker that answers within ``_LOOK`` seconds or computes runs
    alone, so that none loses its time to others; beside those that only wait others start, and their time
    limits run out together."""
    out: list[tuple | None] = [None] * len(rows)
    running: dict[int, _Worker] = {}
    begun = 0
    try:
        while begun < len(rows) or running:
            room = begun < len(rows) and len(running) < at_once
            if room and not any([w.computing() for w in running.values()]):
                running[begun] = _Worker(make, *rows[begun], seconds)
                begun += 1
            left = max(0, min(w.until for w in running.values()) - time.monotonic())
            ready = connection.wait([w.pipe for w in running.values()], min(left, _LOOK) if room else left)
            for i in [i for i, w in running.items() if w.pipe in ready or w.until <= time.monotonic()]:
                out[i] = running.pop(i).result()
    finally:
        for w in running.values():
            w.end()
    return out


def score_isolated(rows: DataFrame, scorer: str, key: str, seconds: float, key_type: str = "long", at_once: int = ISOLATED_AT_ONCE, **options) -> DataFrame:
    """``(key, seed, prob, outcome, error_type, error)`` of every row, each in a fresh process with
    its own seed and a wall-clock limit; no row's failure costs another. A task has up to ``at_once``
    processes; scorers that take much memory need fewer. Rows take long and are small, so they are
    dealt out to all cores first: a small table is often one file."""
    spark = importable(rows.sparkSession)
    factory = REGISTRY[scorer]
    named = rows.withColumn("_seed", entry_seed(F.col(key))).repartition(4 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bare = batch.drop(columns="_seed")
            out = _all_isolated(lambda: factory(**options), [(bare.iloc[i : i + 1], int(batch["_seed"].iloc[i])) for i in range(len(batch))], seconds, at_once)
            made = pd.DataFrame(out, columns=["prob", "outcome", "error_type", "error"])
            yield pd.concat([batch[[key]].reset_index(drop=True), batch[["_seed"]].rename(columns={"_seed": "seed"}).reset_index(drop=True), made], axis=1)

    out = named.mapInPandas(run, f"{key} {key_type}, seed long, {ISOLATED}")
    return out.selectExpr(key, "seed", "nanvl(prob, null) as prob", "outcome", "error_type", "error")
