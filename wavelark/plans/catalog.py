"""Datasets that are resolved from one another: registration, options, lineage, materialisation.

A node builds a lazy DataFrame from those of its dependencies, so a chain of nodes is one plan for
Catalyst. What is asked to be kept is written as Parquet under a key made of the run, the name and a
digest of everything the result depends on; a later request reads it and prunes the chain there.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SAVE = ("never", "target", "always")


@dataclass(frozen=True)
class Option:
    """A setting: default, type, choices, bounds; track False keeps it out of the lineage."""

    default: object = None
    type: type | tuple | None = None
    choices: tuple = ()
    least: float | None = None
    most: float | None = None
    track: bool = True
    help: str = ""

    def check(self, name: str, value):
        if value is None:
            return None
        if self.type in (int, float, str) and not isinstance(value, bool):
            try:
                value = self.type(value)
            except (TypeError, ValueError) as e:
                raise ValueError(f"{name}: {value!r} isn't a {self.type.__name__}") from e
        if self.choices and value not in self.choices:
            raise ValueError(f"{name}: {value!r} isn't one of {self.choices}")
        if (self.least is not None and value < self.least) or (self.most is not None and value > self.most):
            raise ValueError(f"{name}: {value!r} is out of bounds")
        return value


@dataclass
class Node:
    """provides: dataset name; build(context, run, inputs, options) -> DataFrame; needs may depend on options; stamp(context, run, options): what of the outside the result depends on, as text."""

    provides: str
    build: Callable[[Context, str, dict[str, DataFrame], dict], DataFrame]
    needs: tuple[str, ...] | Callable[[dict], Iterable[str]] = ()
    options: Mapping[str, Option] = field(default_factory=dict)
    version: str = "0"
    save_when: str = "never"
    description: str = ""
    stamp: Callable[[Context, str, dict], str] | None = None


def _listed(value):
    """Mappings as sorted lists of pairs, so that keys of any type have a JSON form of their own."""
    if isinstance(value, dict):
        return [[_listed(k), _listed(v)] for k, v in sorted(value.items(), key=lambda kv: str(kv[0]))]
    return [_listed(v) for v in value] if isinstance(value, list | tuple) else value


class Context:
    """Nodes, configuration and where results are kept."""

    def __init__(self, spark: SparkSession, config: Mapping | None = None, store: str | None = None):
        self.spark, self.config, self.store = spark, dict(config or {}), store.rstrip("/") if store else None
        self.nodes: dict[str, Node] = {}
        self.run_config: dict[str, dict] = {}
        self.log: list[dict] = []
        self._building: list[tuple[str, str]] = []
        self._stamps: dict[tuple[str, str], str] = {}

    def register(self, *nodes: Node, replace: bool = False) -> None:
        for n in nodes:
            if n.save_when not in SAVE:
                raise ValueError(f"save_when is one of {SAVE}")
            if n.provides in self.nodes and not replace:
                raise ValueError(f"{n.provides} is provided already")
            self.nodes[n.provides] = n

    def clone(self, **config) -> Context:
        out = Context(self.spark, self.config | config, self.store)
        out.nodes, out.run_config = dict(self.nodes), dict(self.run_config)
        return out

    # ---- configuration: node block, dotted name, global name, run block, default --------------

    def option(self, node: Node, name: str, run: str = ""):
        block = self.config.get(node.provides)
        run_block = self.run_config.get(run, {})
        if isinstance(block, Mapping) and name in block:
            value = block[name]
        elif f"{node.provides}.{name}" in self.config:
            value = self.config[f"{node.provides}.{name}"]
        elif name in self.config:
            value = self.config[name]
        else:
            value = run_block.get(name, node.options[name].default)
        return node.options[name].check(f"{node.provides}.{name}", value)

    def options(self, name: str, run: str = "") -> dict:
        node = self._node(name)
        return {k: self.option(node, k, run) for k in node.options}

    def _node(self, name: str) -> Node:
        if name not in self.nodes:
            raise KeyError(f"nothing provides {name}")
        return self.nodes[name]

    # ---- plan ---------------------------------------------------------------------------------

    def needs(self, name: str, run: str = "") -> tuple[str, ...]:
        n = self._node(name)
        return tuple(n.needs(self.options(name, run)) if callable(n.needs) else n.needs)

    def plan(self, name: str, run: str = "") -> list[str]:
        """Dependencies first; a cycle or a name that nothing provides is an error."""
        done: list[str] = []
        path: list[str] = []

        def visit(x: str) -> None:
            if x in done:
                return
            if x in path:
                raise ValueError("cycle: " + " -> ".join([*path[path.index(x) :], x]))
            path.append(x)
            for d in self.needs(x, run):
                visit(d)
            path.pop()
            done.append(x)

        visit(name)
        return done

    def lineage(self, name: str, run: str = "") -> dict:
        n = self._node(name)
        tracked = {k: v for k, v in self.options(name, run).items() if n.options[k].track}
        own = {"name": name, "version": n.version, "options": tracked, "needs": [self.lineage(d, run) for d in self.needs(name, run)]}
        if n.stamp is None:
            return own
        if (name, run) not in self._stamps:
            self._stamps[name, run] = n.stamp(self, run, self.options(name, run))
        return own | {"stamp": self._stamps[name, run]}

    def refresh(self) -> None:
        """Looks at input files anew: what is kept of others no longer counts."""
        self._stamps.clear()

    def key(self, run: str, name: str) -> str:
        text = json.dumps(_listed(self.lineage(name, run)), default=str)
        return f"{run}-{name}-{hashlib.sha256(text.encode()).hexdigest()[:12]}"

    def _path(self, run: str, name: str) -> str:
        return f"{self.store}/{run}/{self.key(run, name)}"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def is_kept(self, run: str, name: str) -> bool:
        return bool(self.store) and self._exists(self._path(run, name))

    def needed(self, run: str, name: str) -> list[str]:
        """The part of the plan that has to be built: it stops at what is kept."""
        out: list[str] = []

        def visit(x: str) -> None:
            if x in out or self.is_kept(run, x):
                return
            for d in self.needs(x, run):
                visit(d)
            out.append(x)

        visit(name)
        return out

    # ---- execution ----------------------------------------------------------------------------

    def get(self, run: str, name: str) -> DataFrame:
        """The dataset, lazily where nothing on the way is to be kept."""
        self.plan(name, run)
        built: dict[str, DataFrame] = {}

        def make(x: str) -> DataFrame:
            if x in built:
                return built[x]
            if self.is_kept(run, x):
                started = time.monotonic()
                built[x] = self.spark.read.parquet(self._path(run, x))
                self._log(run, x, started, hit=True)
                return built[x]
            node = self._node(x)
            inputs = {d: make(d) for d in self.needs(x, run)}
            started = time.monotonic()
            try:
                df = node.build(self, run, inputs, self.options(x, run))
                if self.store and (node.save_when == "always" or node.save_when == "target" and x == name):
                    path = self._path(run, x)
                    df.write.mode("overwrite").parquet(path)
                    df = self.spark.read.schema(df.schema).parquet(path)
            except Exception as e:
                self._log(run, x, started, ok=False)
                raise RuntimeError(f"{x} failed: {e}") from e
            self._log(run, x, started)
            built[x] = df
            return df

        return make(name)

    def _log(self, run: str, name: str, started: float, ok: bool = True, hit: bool = False) -> None:
        self.log.append({"run": run, "name": name, "kept": ok and (hit or self.is_kept(run, name)), "ok": ok, "hit": hit, "seconds": time.monotonic() - started})

    def get_all(self, run: str, names: Iterable[str]) -> dict[str, DataFrame]:
        return {n: self.get(run, n) for n in names}

    def get_runs(self, runs: Iterable[str], name: str) -> DataFrame:
        """One frame over several runs, with run_id: one job, not one per run."""
        from pyspark.sql import functions as F

        out = None
        for r in runs:
            df = self.get(r, name).withColumn("run_id", F.lit(r))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        if out is None:
            raise ValueError("no runs")
        return out

    def time_range(self, run: str, name: str, start: int | None = None, end: int | None = None, axis: str = "raw_ps", channel: str | None = None) -> DataFrame:
        """Rows of a dataset that start in [start, end) on an axis (raw_ps, or system_ns from time_ns, time or ps), of one "board:channel" if given."""
        from pyspark.sql import functions as F

        if axis not in ("raw_ps", "system_ns"):
            raise ValueError("axis is raw_ps or system_ns")
        df = self.get(run, name)
        column = next((c for c in ("time_ns", "time") if c in df.columns), None) if axis == "system_ns" else "timestamp"
        at = F.col(column) if column else F.expr("timestamp div 1000")
        if start is not None:
            df = df.where(at >= start)
        if end is not None:
            df = df.where(at < end)
        if channel is not None:
            board, _, number = channel.partition(":")
            df = df.where((F.col("board") == int(board)) & (F.col("channel") == int(number)))
        return df

    def discover(self, group: str = "wavelark.nodes") -> list[str]:
        """Registers the nodes that installed packages offer under an entry point: each a Node or a function that returns some."""
        from importlib.metadata import entry_points

        found = []
        for point in entry_points(group=group):
            item = point.load()
            nodes = [item] if isinstance(item, Node) else list(item())
            self.register(*nodes)
            found += [n.provides for n in nodes]
        return found

    def search(self, pattern: str) -> list[str]:
        return sorted(n for n in self.nodes if re.search(pattern, n, re.I))


def grid(context: Context, run: str, name: str, settings: Iterable[Mapping]) -> list[tuple[Mapping, DataFrame]]:
    """The dataset under each of several configurations."""
    return [(s, context.clone(**s).get(run, name)) for s in settings]


def process_runs(context: Context, runs: Iterable[str], function: Callable[[Context, str], object], on_error: str = "continue", retries: int = 0) -> dict:
    """function(context, run) for each run: results, errors, order. on_error: continue, stop or raise."""
    if on_error not in ("continue", "stop", "raise"):
        raise ValueError("on_error is continue, stop or raise")
    results, errors, order = {}, {}, []
    for r in runs:
        order.append(r)
        for attempt in range(retries + 1):
            try:
                results[r] = function(context, r)
                break
            except Exception as e:
                if attempt == retries:
                    if on_error == "raise":
                        raise
                    errors[r] = e
        if r in errors and on_error == "stop":
            break
    return {"results": results, "errors": errors, "ordered_run_ids": order}


def layers(context: Context, name: str, run: str = "") -> dict[str, int]:
    """Depth of each dataset below the target's sources; equal depths don't wait for one another."""
    depth: dict[str, int] = {}
    for x in context.plan(name, run):
        depth[x] = 1 + max((depth[d] for d in context.needs(x, run)), default=-1)
    return depth
