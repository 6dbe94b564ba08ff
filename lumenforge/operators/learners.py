"""Bandit learners with a small state, for batch rounds and for streams.

A learner holds, for each arm, trials, rewards seen, their sum and sum of squares, and what its rule
needs besides; all of it is a JSON text, so that it can be a column.  Rewards are divided by
``reward_scale``.  Randomness comes from (seed, trials), so a replayed batch decides alike.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


class Learner:
    DEFAULTS: dict = {"min_trial": 0, "reward_scale": 1.0, "seed": 1}

    def __init__(self, arms: list[str], **options):
        self.arms = sorted(arms)
        unknown = set(options) - set(self.all_defaults())
        if unknown:
            raise ValueError(f"unknown options {sorted(unknown)}")
        self.o = {**self.all_defaults(), **options}
        self.total = 0
        self.trials = dict.fromkeys(self.arms, 0)
        self.n = dict.fromkeys(self.arms, 0)
        self.sum = dict.fromkeys(self.arms, 0.0)
        self.sq = dict.fromkeys(self.arms, 0.0)
        self.extra: dict = self.start()

    @classmethod
    def all_defaults(cls) -> dict:
        out: dict = {}
        for c in reversed(cls.__mro__):
            out |= c.__dict__.get("DEFAULTS", {})
        return out

    def start(self) -> dict:
        return {}

    def mean(self, a: str) -> float:
        return self.sum[a] / self.n[a] if self.n[a] else 0.0

    def deviation(self, a: str) -> float:
        return math.sqrt(max(0.0, self.sq[a] / self.n[a] - self.mean(a) ** 2)) if self.n[a] else 0.0

    def best(self, score) -> str:
        """The arm of the greatest score, the first by name of equals."""
        return max(self.arms, key=lambda a: (round(score(a), 12), [-ord(c) for c in a]))

    def draw(self, rng, p: dict[str, float]) -> str:
        w = np.array([max(0.0, p[a]) for a in self.arms])
        return self.arms[int(rng.choice(len(w), p=w / w.sum()))]

    def next_action(self) -> str:
        self.total += 1
        rng = np.random.default_rng([self.o["seed"], self.total])
        few = [a for a in self.arms if self.trials[a] < self.o["min_trial"]]
        a = few[0] if few else self.choose(rng)
        self.trials[a] += 1
        return a

    def choose(self, rng) -> str:
        raise NotImplementedError

    def set_reward(self, a: str, reward: float) -> None:
        r = float(reward) / self.o["reward_scale"]
        self.n[a] += 1
        self.sum[a] += r
        self.sq[a] += r * r
        self.rewarded(a, r)

    def rewarded(self, a: str, r: float) -> None:
        pass

    def state(self) -> str:
        return json.dumps({k: getattr(self, k) for k in ("arms", "total", "trials", "n", "sum", "sq", "extra")}, sort_keys=True)

    def load(self, text: str | None) -> "Learner":
        for k, v in json.loads(text or "{}").items():
            setattr(self, k, v)
        return self


class Ucb1(Learner):
    DEFAULTS = {"min_trial": 1}

    def choose(self, rng):
        return self.best(lambda a: self.mean(a) + math.sqrt(2 * math.log(self.total) / max(1, self.trials[a])))


class Ucb2(Learner):
    """Epochs: an arm chosen for the r-th time is played (1 + alpha)^(r+1) - (1 + alpha)^r times."""

    DEFAULTS = {"min_trial": 1, "alpha": 0.1}

    def start(self):
        return {"epochs": dict.fromkeys(self.arms, 0), "arm": None, "left": 0}

    def choose(self, rng):
        x, k = self.extra, 1 + self.o["alpha"]
        if x["arm"] is not None and x["left"] > 0:
            x["left"] -= 1
            return x["arm"]
        if x["arm"] is not None:
            x["epochs"][x["arm"]] += 1
        bonus = lambda tau: math.sqrt(max(0.0, k * math.log(math.e * self.total / tau) / (2 * tau)))
        a = self.best(lambda b: self.mean(b) + bonus(k ** x["epochs"][b]))
        r = x["epochs"][a]
        x["arm"], x["left"] = a, max(1, round(k ** (r + 1) - k**r)) - 1
        return a


class RandomGreedy(Learner):
    """Explores with a probability that stays, or falls as c / t or c ln t / t."""

    DEFAULTS = {"probability": 0.5, "reduction": "linear", "constant": 1.0, "least": 0.0}

    def choose(self, rng):
        t, c = self.total, self.o["constant"]
        p = {"none": 1.0, "linear": c / t, "logLinear": c * math.log(t + 1) / t}[self.o["reduction"]]
        p = max(self.o["least"], self.o["probability"] * min(1.0, p))
        return self.arms[int(rng.integers(len(self.arms)))] if rng.random() < p else self.best(self.mean)


class SoftMax(Learner):
    DEFAULTS = {"temperature": 1.0, "reduction": "linear", "least": 0.01}

    def choose(self, rng):
        t = self.total
        k = {"none": 1.0, "linear": 1 / t, "logLinear": math.log(t + 1) / t}[self.o["reduction"]]
        heat = max(self.o["least"], self.o["temperature"] * min(1.0, k))
        top = max(self.mean(a) for a in self.arms)
        return self.draw(rng, {a: math.exp((self.mean(a) - top) / heat) for a in self.arms})


class Thompson(Learner):
    """Draws from the normal law of each arm's mean once it has enough rewards, else from the range of rewards."""

    DEFAULTS = {"min_sample": 5, "max_reward": 1.0}

    def sample(self, rng, a):
        if self.n[a] < self.o["min_sample"]:
            return rng.random() * self.o["max_reward"]
        return rng.normal(self.mean(a), self.deviation(a) / math.sqrt(self.n[a]) + 1e-12)

    def choose(self, rng):
        got = {a: self.sample(rng, a) for a in self.arms}
        return self.best(got.__getitem__)


class OptimisticThompson(Thompson):
    def sample(self, rng, a):
        return max(super().sample(rng, a), self.mean(a))


class IntervalEstimator(Learner):
    """Upper bound of a normal interval whose confidence falls in steps to a floor."""

    DEFAULTS = {"min_sample": 3, "confidence": 0.95, "least": 0.5, "step": 0.05, "every": 50}

    def choose(self, rng):
        if min(self.n.values()) < self.o["min_sample"]:
            return self.arms[int(rng.integers(len(self.arms)))]
        c = max(self.o["least"], self.o["confidence"] - self.o["step"] * (self.total // self.o["every"]))
        lo, hi = 0.0, 10.0  # the two-sided normal quantile, by bisection
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if math.erf(mid / math.sqrt(2)) < c else (lo, mid)
        return self.best(lambda a: self.mean(a) + lo * self.deviation(a) / math.sqrt(self.n[a]))


class ActionPursuit(Learner):
    DEFAULTS = {"rate": 0.05}

    def start(self):
        return {"p": dict.fromkeys(self.arms, 1 / len(self.arms)), "new": False}

    def choose(self, rng):
        p = self.extra["p"]
        if self.extra["new"]:
            top = self.best(self.mean)
            for a in self.arms:
                p[a] += self.o["rate"] * ((a == top) - p[a])
            self.extra["new"] = False
        return self.draw(rng, p)

    def rewarded(self, a, r):
        self.extra["new"] = True


class RewardComparison(Learner):
    """Preferences move by how far an arm's mean exceeds a reference reward, which follows it."""

    DEFAULTS = {"preference_rate": 0.1, "reference_rate": 0.1, "reference": 0.0}

    def start(self):
        return {"preference": dict.fromkeys(self.arms, 0.0), "reference": self.o["reference"]}

    def choose(self, rng):
        q = self.extra["preference"]
        top = max(q.values())
        return self.draw(rng, {a: math.exp(q[a] - top) for a in self.arms})

    def rewarded(self, a, r):
        gap = self.mean(a) - self.extra["reference"]
        self.extra["preference"][a] += self.o["preference_rate"] * gap
        self.extra["reference"] += self.o["reference_rate"] * gap


class ExponentialWeight(Learner):
    DEFAULTS = {"gamma": 0.1}

    def start(self):
        return {"log_weight": dict.fromkeys(self.arms, 0.0)}

    def shares(self) -> dict[str, float]:
        w, g = self.extra["log_weight"], self.o["gamma"]
        top = max(w.values())
        e = {a: math.exp(w[a] - top) for a in self.arms}
        return {a: (1 - g) * e[a] / sum(e.values()) + g / len(self.arms) for a in self.arms}

    def choose(self, rng):
        return self.draw(rng, self.shares())

    def rewarded(self, a, r):
        self.extra["log_weight"][a] += self.o["gamma"] * r / (self.shares()[a] * len(self.arms))


class ExponentialWeightExpert(Learner):
    """Experts advise shares of the arms; their weights grow with what their advice would have earned."""

    DEFAULTS = {"gamma": 0.1, "experts": ()}

    def start(self):
        return {"log_weight": [0.0] * len(self.advice())}

    def advice(self) -> list[dict[str, float]]:
        return list(self.o["experts"]) or [dict.fromkeys(self.arms, 1 / len(self.arms))]

    def shares(self):
        w, g = self.extra["log_weight"], self.o["gamma"]
        e = [math.exp(x - max(w)) for x in w]
        return {a: (1 - g) * sum(k * x[a] for k, x in zip(e, self.advice(), strict=True)) / sum(e) + g / len(self.arms) for a in self.arms}

    def choose(self, rng):
        return self.draw(rng, self.shares())

    def rewarded(self, a, r):
        est = r / self.shares()[a]
        for i, x in enumerate(self.advice()):
            self.extra["log_weight"][i] += self.o["gamma"] * x[a] * est / len(self.arms)


#: Names are fixed values: configurations use them.
LEARNERS = {
    "intervalEstimator": IntervalEstimator,
    "thompsonSampler": Thompson,
    "optimisticThompsonSampler": OptimisticThompson,
    "randomGreedy": RandomGreedy,
    "upperConfidenceBoundOne": Ucb1,
    "upperConfidenceBoundTwo": Ucb2,
    "softMax": SoftMax,
    "actionPursuit": ActionPursuit,
    "rewardComparison": RewardComparison,
    "exponentialWeight": ExponentialWeight,
    "exponentialWeightExpert": ExponentialWeightExpert,
}


def create(name: str, arms: list[str], **options) -> Learner:
    return LEARNERS[name](arms, **options)


def batch_round(states: DataFrame, rewards: DataFrame, arms: list[str], name: str, batch: int = 1, **options) -> DataFrame:
    """One round for every group: takes rewards in, and gives ``batch`` actions and the new state.

    states: grp, state (JSON; null at first).  rewards: grp, seq, arm, reward; taken in order of seq.
    A group's rows meet in one task; across groups the work is spread.
    """
    if not {c: t for c, t in states.dtypes}.get("grp"):
        raise ValueError("states has no column grp")
    kind = dict(states.dtypes)["grp"]

    def finished(grp, held, came):
        learner = create(name, arms, **options).load(held)
        for a, r in came:
            learner.set_reward(a, r)
        return grp, ",".join(learner.next_action() for _ in range(batch)), learner.state()

    def run(batches):
        """Rows come by group, its state first, then its rewards by seq; a group may go on in the next batch."""
        grp, held, came, out, begun = None, None, [], [], False
        for b in batches:
            out = []
            for g, first, state, arm, reward in zip(*(b.column(c).to_pylist() for c in ("grp", "_first", "state", "arm", "reward"))):
                if not begun or g != grp:
                    if begun:
                        out.append(finished(grp, held, came))
                    grp, held, came, begun = g, None, [], True
                if first:
                    held = held or state
                else:
                    came.append((arm, math.nan if reward is None else reward))
            yield rows_of(out)
        if begun:
            yield rows_of([finished(grp, held, came)])

    made = T._parse_datatype_string(f"grp {kind}, actions string, state string")
    arrow = to_arrow_schema(made)

    def rows_of(out):
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(arrow)], schema=arrow)

    x = states.select("grp", F.lit(True).alias("_first"), F.lit(None).cast(dict(rewards.dtypes)["seq"]).alias("seq"), "state", F.lit(None).cast("string").alias("arm"), F.lit(None).cast("double").alias("reward"))
    y = rewards.select("grp", F.lit(False).alias("_first"), "seq", F.lit(None).cast("string").alias("state"), F.col("arm").cast("string").alias("arm"), F.col("reward").cast("double").alias("reward"))
    return x.unionAll(y).repartition("grp").sortWithinPartitions("grp", F.desc("_first"), "seq").mapInArrow(run, made)


def explore_rounds(arms: int, factor: float | None = None, difference: float = 0.2, confidence: float = 0.05) -> int:
    """Rounds to explore: a factor of the arms, or the PAC bound 4 / d^2 + ln(2 n / p)."""
    return math.ceil(factor * arms) if factor else math.ceil(4 / difference**2 + math.log(2 * arms / confidence))
