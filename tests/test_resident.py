"""Scorers are loaded once per worker."""

import os

from pyspark.sql import functions as F

from verigauge.operators.scoring import Scorer, score


class Logged(Scorer):
    name = "logged"

    def __init__(self, log, level):
        self.log, self.level, self.loaded = log, level, False

    def note(self, what):
        with open(self.log, "a") as f:
            f.write(f"{what} {self.level} {os.getpid()}\n")

    def load(self):
        self.loaded = True
        self.note("load")

    def unload(self):
        self.note("unload")

    def predict_batch(self, rows):
        assert self.loaded
        self.note("batch")
        return [self.level] * len(rows)


def lines(log):
    with open(log) as f:
        return [tuple(x.split()) for x in f]


def test_loads_per_worker(spark, tmp_path):
    log = str(tmp_path / "log")
    df = spark.range(0, 4000, 1, 40)
    assert score(df, Logged(log, 0.25), ["id"]).where("score = 0.25").count() == 4000
    first = lines(log)
    pids = {p for what, _, p in first if what == "batch"}
    loads = [p for what, _, p in first if what == "load"]
    assert len([1 for what, *_ in first if what == "batch"]) == 40
    # more tasks than workers, no worker twice
    assert len(loads) == len(set(loads)) and pids <= set(loads) and len(loads) < 40
    # an equal scorer in another query is found loaded
    assert score(df, Logged(log, 0.25), ["id"]).agg(F.sum("score")).first()[0] == 1000
    again = lines(log)[len(first):]
    assert not {p for what, _, p in again if what == "load"} & set(loads)
    # other options: the old one goes, the new one comes, once
    before = len(lines(log))
    assert score(df, Logged(log, 0.5), ["id"]).where("score = 0.5").count() == 4000
    change = lines(log)[before:]
    for pid in {p for _, _, p in change}:
        mine = [what for what, _, p in change if p == pid]
        assert mine.count("load") == 1 and mine.index("load") <= 1 and mine.count("unload") <= 1
