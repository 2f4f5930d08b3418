"""Walk an analyzed plan and compute a tag for every output cell beside the values.

Every node is rebuilt on its tracked children with the same expression ids, plus tag
columns where a tag isn't the identity.  Values are the ones of the untracked plan; the
optimizer sees plain columns, so pushdown, pruning and code generation stay.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Untrackable
from ..functions.lattice import BOOL_OR, Lattice
from . import labels
from .catalyst import Bridge, analyzed, items, key, kind

log = logging.getLogger("provenant")

#: A tag is None (identity), a Column, or {field: tag} of a struct.
Tag = "None | Column | dict[str, Tag]"

_SAME = frozenset(
    "Filter Sort GlobalLimit LocalLimit Offset Tail Sample Repartition RepartitionByExpression RebalancePartitions "
    "ResolvedHint EventTimeWatermark CollectMetrics WithWindowDefinition SubqueryAlias View".split()
)
_RANKS = frozenset("RowNumber Rank DenseRank PercentRank CumeDist NTile".split())
_STRUCTURE = frozenset("Grouping GroupingID VirtualColumn InputFileName SparkPartitionID MonotonicallyIncreasingID".split())


@dataclass
class Node:
    """A tracked plan: its frame, its value attributes in order, and their tags by expression id."""

    frame: DataFrame
    output: list
    tags: dict[int, Tag] = field(default_factory=dict)


class Walker:
    def __init__(self, spark, lattice: Lattice = BOOL_OR, distinct: str = "values", implicit: str = "log", coarse: bool = True):
        self.b = Bridge(spark)
        self.lattice, self.distinct, self.implicit, self.coarse = lattice, distinct, implicit, coarse
        self.names = count()
        self.ctes: dict[int, object] = {}
        self.fallbacks: list[str] = []

    # -- tags ---------------------------------------------------------------

    def join(self, tags) -> Tag:
        flat = [t for tag in tags for t in self.flat(tag)]
        seen: dict[str, Column] = {}
        for t in flat:  # the same tag twice is one
            seen.setdefault(t._jc.toString(), t)
        if not seen:
            return None
        return next(iter(seen.values())) if len(seen) == 1 else self.lattice.join(list(seen.values()))

    def flat(self, tag: Tag) -> list[Column]:
        if tag is None:
            return []
        if isinstance(tag, dict):
            return [c for t in tag.values() for c in self.flat(t)]
        return [tag]

    def mapped(self, tag: Tag, f) -> Tag:
        if tag is None:
            return None
        if isinstance(tag, dict):
            return {k: self.mapped(t, f) for k, t in tag.items()}
        return f(tag)

    def expression(self, e, tags: dict[int, Tag]) -> Tag:
        """The tag of a resolved expression."""
        name = kind(e)
        if name == "AttributeReference":
            return tags.get(key(e))
        if name == "OuterReference":
            return tags.get(key(e.e()))
        if name in ("Alias", "Cast", "ToPrettyString", "AnsiCast", "UpCast", "KnownNotNull", "KnownNullable", "TempResolvedColumn"):
            tag = self.expression(e.children().head(), tags)
            return tag if name == "Alias" else self.join([tag])
        if name in ("Literal", "NamedLambdaVariable") or name in _STRUCTURE:
            return None
        if name == "GetStructField":
            tag = self.expression(e.child(), tags)
            if isinstance(tag, dict):
                return tag[e.child().dataType().fields()[e.ordinal()].name()]
            return tag
        if name == "CreateNamedStruct":
            parts = items(e.children())
            out = {k.toString(): self.expression(v, tags) for k, v in zip(parts[::2], parts[1::2], strict=True)}
            return out if any(map(self.flat, out.values())) else None
        if name == "AggregateExpression":  # its FILTER decides which rows count: an implicit flow
            return self.join([self.expression(e.aggregateFunction(), tags)])
        if name == "ScalarSubquery":
            return self._scalar(e)
        if name in ("Exists", "InSubquery", "ListQuery", "LateralSubquery"):
            raise Untrackable(f"{name} as a value")
        return self.join([self.expression(c, tags) for c in items(e.children())])

    def _scalar(self, e) -> Tag:
        if e.outerAttrs().size():
            if any(n in e.plan().toString() for n in labels.REGISTRY):
                raise Untrackable("correlated scalar subquery")
            return None
        inner = self.walk(e.plan())
        tag = self.join([inner.tags.get(key(inner.output[0]))])
        if tag is None:
            return None
        return self.lattice.cleaned(inner.frame.agg(self.lattice.over_rows(tag)).scalar())

    def _named(self, frame: DataFrame, columns: list, tags: dict[int, Tag], output: list) -> Node:
        """Select `columns` and, for each id of `tags`, its tag columns under fresh names."""
        new: dict[str, Column] = {}

        def name(tag: Column) -> Column:
            new[n := f"__t{next(self.names)}"] = tag
            return n

        named = {k: self.mapped(t, name) for k, t in tags.items() if self.flat(t)}
        frame = frame.select(*columns, *(t.alias(n) for n, t in new.items()))
        ids = {a.name(): a for a in items(analyzed(frame).output())[len(columns) :]}
        return Node(frame, output, {k: self.mapped(t, lambda n: self.b.column(ids[n])) for k, t in named.items()})

    # -- plans --------------------------------------------------------------

    def walk(self, plan) -> Node:
        try:
            return self._walk(plan)
        except Untrackable as why:
            if not self.coarse:
                raise
            self.fallbacks.append(str(why))
            log.warning("one tag for a whole table: %s", why)
            return self._one_tag(plan)

    def _walk(self, plan) -> Node:
        name = kind(plan)
        if name == "SubqueryAlias" and plan.alias() in labels.REGISTRY:
            return self._label(plan, labels.REGISTRY[plan.alias()])
        handler = getattr(self, f"_{name.lower()}", None)
        if handler:
            return handler(plan)
        if name in _SAME:
            return self._same(plan)
        if not plan.children().size():
            return Node(self.b.frame(plan), items(plan.output()))
        raise Untrackable(f"plan node {name}")

    def _same(self, plan) -> Node:
        child = self.walk(plan.children().head())
        name = kind(plan)
        frame = child.frame if name in ("SubqueryAlias", "View") else self.b.with_children(plan, [child.frame])
        node = Node(frame, items(plan.output()), child.tags)
        return self._flow(node, plan.condition(), child.tags) if name == "Filter" else node

    def _flow(self, node: Node, condition, tags: dict[int, Tag]) -> Node:
        """What a predicate tells about the rows that pass it."""
        if self.implicit == "off":
            return node
        try:
            tag = self.join([self.expression(condition, tags)])
        except Untrackable:
            tag = None
        if tag is None:
            return node
        if self.implicit == "log":
            log.info("implicit flow of a predicate: %s", condition.toString())
            return node
        strict = {}
        for a in node.output:
            own = node.tags.get(key(a))
            strict[key(a)] = {k: self.join([t, tag]) for k, t in own.items()} if isinstance(own, dict) else self.join([own, tag])
        return self._named(node.frame, [self.b.column(a) for a in node.output], strict, node.output)

    def _label(self, plan, spec) -> Node:
        child = self.walk(plan.child())
        at = {a.name(): a for a in child.output}
        columns = [self.b.column(a) for a in child.output]
        own = self.b.frame(plan)  # the predicates see the labelled columns by name
        schema = own.schema

        def tag(path: str, data: T.DataType, old: Tag) -> Tag:
            if isinstance(data, T.StructType) and data.fields:
                inner = {f.name: tag(f"{path}.{f.name}", f.dataType, old[f.name] if isinstance(old, dict) else old) for f in data.fields}
                return inner if any(map(self.flat, inner.values())) else None
            if path not in spec:
                return old
            new = self.lattice.top() if spec[path] is None else self.lattice.cleaned(spec[path])
            return self.join([old, new])

        tags = dict(child.tags)
        for f in schema.fields:
            tags[key(at[f.name])] = tag(f.name, f.dataType, child.tags.get(key(at[f.name])))
        return self._named(child.frame, columns, tags, child.output)

    def _project(self, plan) -> Node:
        child = self.walk(plan.child())
        wanted = items(plan.projectList())
        tags = {key(e): self.expression(e, child.tags) for e in wanted}
        return self._named(child.frame, [self.b.column(e) for e in wanted], tags, items(plan.output()))

    def _aggregate(self, plan) -> Node:
        child = self.walk(plan.child())
        results = items(plan.aggregateExpressions())
        tags = {key(e): self.mapped(self.expression(e, child.tags), self.lattice.over_rows) for e in results}
        keys, output = items(plan.groupingExpressions()), items(plan.output())
        if any(self._has(e, "PythonUDAF") for e in results) and any(map(self.flat, tags.values())):
            return self._beside(plan, child, keys, tags, output)
        return self._grouped(child, keys, [self.b.column(e) for e in results], tags, output)

    def _has(self, e, name: str) -> bool:
        return kind(e) == name or any(self._has(c, name) for c in items(e.children()))

    def _beside(self, plan, child: Node, keys: list, tags: dict[int, Tag], output: list) -> Node:
        """Python aggregates can't share an aggregation with built-in ones: tags get their own, joined on the keys."""
        flat: dict[str, Column] = {}

        def name(tag: Column) -> str:
            flat[n := f"__t{next(self.names)}"] = tag
            return n

        named = {k: self.mapped(t, name) for k, t in tags.items() if self.flat(t)}
        aliases = [f"__k{k}" for k in range(len(keys))]
        beside = child.frame.groupBy(*(self.b.column(k).alias(a) for k, a in zip(keys, aliases, strict=True))).agg(*(t.alias(n) for n, t in flat.items()))
        ids = {key(e): e for e in output}
        own = [next((a for e, a in zip(items(plan.aggregateExpressions()), output, strict=True) if key(e) in ids and self._same_key(e, k)), None) for k in keys]
        if any(a is None for a in own):
            raise Untrackable("a Python aggregate whose keys aren't in its result")
        values = self.b.frame(plan)
        if not keys:
            frame = values.select(*(self.b.column(a) for a in output), *(beside.select(n).scalar().alias(n) for n in flat))
        else:
            frame = values.join(beside, [self.b.column(a).eqNullSafe(beside[n]) for a, n in zip(own, aliases, strict=True)], "left")
        got = {a.name(): a for a in items(analyzed(frame).output())[len(output) :]}
        return Node(frame, output, {k: self.mapped(t, lambda n: self.lattice.cleaned(self.b.column(got[n]))) for k, t in named.items()})

    def _same_key(self, result, group) -> bool:
        inner = result.child() if kind(result) == "Alias" else result
        return inner.semanticEquals(group)

    def _grouped(self, child: Node, keys: list, columns: list[Column], tags: dict[int, Tag], output: list) -> Node:
        conf = self.b.spark.conf
        before = conf.get("spark.sql.retainGroupColumns")
        conf.set("spark.sql.retainGroupColumns", "false")  # the results name the keys themselves
        try:
            names: dict[str, Column] = {}

            def name(tag: Column) -> str:
                names[n := f"__t{next(self.names)}"] = tag
                return n

            named = {k: self.mapped(t, name) for k, t in tags.items() if self.flat(t)}
            frame = child.frame.groupBy(*(self.b.column(k) for k in keys)).agg(*columns, *(t.alias(n) for n, t in names.items()))
        finally:
            conf.set("spark.sql.retainGroupColumns", before)
        ids = {a.name(): a for a in items(analyzed(frame).output())[len(columns) :]}
        return Node(frame, output, {k: self.mapped(t, lambda n: self.b.column(ids[n])) for k, t in named.items()})

    def _expand(self, plan) -> Node:
        """Rollup, cube and grouping sets: a key's tag goes with its copies."""
        child = self.walk(plan.child())
        projections = [items(p) for p in items(plan.projections())]
        output = items(plan.output())
        carried = {a.toString(): a for a in items(analyzed(child.frame).output()) if a.name().startswith("__t")}
        extra = list(carried.values())
        expand = self.b.jvm.org.apache.spark.sql.catalyst.plans.logical.Expand(
            self.b.seq([self.b.seq([*p, *extra]) for p in projections]), self.b.seq([*output, *extra]), analyzed(child.frame)
        )
        tags = {key(a): self.join([self.expression(p[k], child.tags) for p in projections]) for k, a in enumerate(output)}
        return Node(self.b.frame(expand), output, tags)

    def _join(self, plan) -> Node:
        left, right = self.walk(plan.left()), self.walk(plan.right())
        frame = self.b.with_children(plan, [left.frame, right.frame])
        tags = {k: self.mapped(t, self.lattice.cleaned) for k, t in (left.tags | right.tags).items()}
        node = Node(frame, items(plan.output()), tags)
        if plan.condition().isDefined() and "Outer" not in kind(plan.joinType()):
            return self._flow(node, plan.condition().get(), tags)
        return node

    def _union(self, plan) -> Node:
        children = [self.walk(c) for c in items(plan.children())]
        output = items(plan.output())

        def unite(tags: list[Tag]) -> Tag:
            if any(isinstance(t, dict) for t in tags):
                names = next(t for t in tags if isinstance(t, dict))
                return {n: unite([t[n] if isinstance(t, dict) else t for t in tags]) for n in names}
            return tags if any(t is not None for t in tags) else None

        tags = {key(a): unite([c.tags.get(key(c.output[k])) for c in children]) for k, a in enumerate(output)}
        frames, named = [], {}
        for n, c in enumerate(children):
            new: list[Column] = []

            def pick(lists, new=new, n=n):
                if isinstance(lists, dict):
                    return {k: pick(v, new, n) for k, v in lists.items()}
                if lists is None:
                    return None
                name = f"__u{len(new)}"
                new.append((self.lattice.identity() if lists[n] is None else lists[n]).alias(name))
                return name

            named = {k: pick(t) for k, t in tags.items()}
            frames.append(c.frame.select(*(self.b.column(a) for a in c.output), *new))
        frame = frames[0]
        for f in frames[1:]:
            frame = frame.union(f)
        frame = self.b.under_ids(frame, items(analyzed(frame).output())[: len(output)], output)
        ids = {a.name(): a for a in items(analyzed(frame).output())[len(output) :]}
        tags = {k: self.mapped(t, lambda n: self.b.column(ids[n])) for k, t in named.items() if t is not None}
        return Node(frame, output, tags)

    def _distinct(self, plan) -> Node:
        child = self.walk(plan.child())
        columns = [self.b.column(a) for a in child.output]
        if self.distinct == "cells":
            tags = {k: t for k, t in child.tags.items() if any(key(a) == k for a in child.output)}
            node = self._named(child.frame, columns, tags, child.output)
            return Node(node.frame.distinct(), node.output, node.tags)
        tags = {key(a): self.mapped(child.tags.get(key(a)), self.lattice.over_rows) for a in child.output}
        return self._grouped(child, child.output, columns, tags, child.output)

    def _deduplicate(self, plan) -> Node:
        child = self.walk(plan.child())
        keys = items(plan.keys())
        if len(keys) == len(child.output):
            return self._distinct(plan)
        ids = {key(k) for k in keys}
        columns = []
        for a in child.output:
            if key(a) in ids:
                columns.append(self.b.column(a))
            else:  # whichever row stays, as without tracking
                first = analyzed(child.frame.agg(F.first(self.b.column(a)))).aggregateExpressions().head().child()
                columns.append(self.b.as_attribute(first, a))
        tags = {key(a): self.mapped(child.tags.get(key(a)), self.lattice.over_rows) for a in child.output}
        return self._grouped(child, keys, columns, tags, child.output)

    def _set_operation(self, plan) -> Node:
        """INTERSECT and EXCEPT: the plan's own rows with the left side's tags of equal values."""
        left = self.walk(plan.left())
        output = items(plan.output())
        tags = {key(a): left.tags.get(key(a)) for a in left.output}
        if not any(map(self.flat, tags.values())):
            return Node(self.b.frame(plan), output)
        names = [f"__k{k}" for k in range(len(left.output))]
        flat: dict[str, Column] = {}

        def name(tag: Column) -> str:
            flat[n := f"__t{next(self.names)}"] = self.lattice.over_rows(tag)
            return n

        named = {k: self.mapped(t, name) for k, t in tags.items() if self.flat(t)}
        keyed = left.frame.groupBy(*(self.b.column(a).alias(n) for a, n in zip(left.output, names, strict=True))).agg(*(t.alias(n) for n, t in flat.items()))
        values = self.b.frame(plan)
        same = [self.b.column(a).eqNullSafe(keyed[n]) for a, n in zip(output, names, strict=True)]
        frame = values.join(keyed, same, "left")
        ids = {a.name(): a for a in items(analyzed(frame).output())[len(output) :]}
        got = {key(o): self.mapped(named.get(key(a)), lambda n: self.lattice.cleaned(self.b.column(ids[n]))) for a, o in zip(left.output, output, strict=True)}
        return Node(frame, output, got)

    _intersect = _except = _set_operation

    def _generate(self, plan) -> Node:
        child = self.walk(plan.child())
        tags = dict(child.tags)
        own = self.join([self.expression(plan.generator(), child.tags)])
        tags |= {key(a): own for a in items(plan.generatorOutput())}
        return Node(self.b.with_children(plan, [child.frame]), items(plan.output()), tags)

    def _lateraljoin(self, plan) -> Node:
        """Rows that a table function or subquery makes of each row: tagged by the columns that it reads."""
        child, inner = self.walk(plan.left()), plan.right()
        if self._sources(inner.plan()):
            raise Untrackable("lateral subquery over labelled tables")
        own = self.join([self.expression(a, child.tags) for a in items(inner.outerAttrs())])
        tags = child.tags | {key(a): own for a in items(inner.plan().output())}
        return Node(self.b.with_children(plan, [child.frame]), items(plan.output()), tags)

    def _window(self, plan) -> Node:
        child = self.walk(plan.child())
        frame = self.b.with_children(plan, [child.frame])
        tags = dict(child.tags)
        strict = self.implicit == "strict"
        for alias in items(plan.windowExpressions()):
            window = alias.child()
            while kind(window) != "WindowExpression":
                if window.children().size() != 1:
                    raise Untrackable("compound window expression")
                window = window.children().head()
            tags[key(alias)] = self._over(child, window, strict)
        columns = [self.b.column(a) for a in items(plan.output())]
        return self._named(frame, columns, tags | {k: None for k in tags if k not in {key(a) for a in items(plan.output())}}, items(plan.output()))

    def _over(self, child: Node, window, strict: bool) -> Tag:
        function, spec = window.windowFunction(), window.windowSpec()
        flows = [self.expression(e, child.tags) for e in (*items(spec.partitionSpec()), *items(spec.orderSpec()))] if strict else []
        if kind(function) in _RANKS:
            return self.join(flows)
        tag = self.join([self.expression(function, child.tags)])
        if tag is None:
            return self.join(flows)
        if kind(function) in ("Lag", "Lead"):
            over = self._moved(child, function, spec)
        else:
            over = self._row_aggregate_over(child, tag, spec)
        return self.join([over, *flows])

    def _moved(self, child: Node, function, spec) -> Column:
        """The tag of the row that lag or lead takes the value of; where there is none, the tag of the default.

        A null value's tag is null, so that IGNORE NULLS passes over the same rows.
        """
        catalyst = self.b.jvm.org.apache.spark.sql.catalyst.expressions
        value, offset, default = items(function.children())
        own, other = (self.join([self.expression(e, child.tags)]) for e in (value, default))
        tag = self.lattice.identity() if own is None else self.lattice.cleaned(own)
        if function.ignoreNulls():
            tag = F.when(self.b.column(value).isNotNull(), tag)
        elsewhere = self.lattice.identity() if other is None else self.lattice.cleaned(other)
        resolved = [e.child() for e in items(analyzed(child.frame.select(tag.alias("__tag"), elsewhere.alias("__default"))).projectList())]
        moved = function.withNewChildren(self.b.seq([resolved[0], offset, resolved[1]]))
        return self.lattice.cleaned(self.b.column(catalyst.WindowExpression(moved, spec)))

    def _row_aggregate_over(self, child: Node, tag: Column, spec) -> Column:
        """The lattice's row aggregate, each aggregate function in it over `spec`."""
        catalyst = self.b.jvm.org.apache.spark.sql.catalyst.expressions
        resolved = analyzed(child.frame.agg(self.lattice.over_rows(tag).alias("__tag"))).aggregateExpressions().head().child()

        def rebuilt(e):
            if kind(e) == "AggregateExpression":
                return catalyst.WindowExpression(e, spec)
            inner = items(e.children())
            return e.withNewChildren(self.b.seq([rebuilt(c) for c in inner])) if inner else e

        return self.b.column(rebuilt(resolved))

    def _withcte(self, plan) -> Node:
        for d in items(plan.cteDefs()):
            self.ctes[d.id()] = d.child()
        return self.walk(plan.plan())

    def _cterelationref(self, plan) -> Node:
        inner = self.walk(self.ctes[plan.cteId()])
        output = items(plan.output())
        tags = {key(o): inner.tags.get(key(a)) for a, o in zip(inner.output, output, strict=True)}
        return Node(self.b.under_ids(inner.frame, inner.output, output), output, tags)

    # -- fallback -------------------------------------------------------------

    def _one_tag(self, plan) -> Node:
        """The plan's own values; every cell gets the join of all tags of all its labelled inputs."""
        found = []
        for source in self._sources(plan):
            inner = self._label(source, labels.REGISTRY[source.alias()])
            tag = self.join(inner.tags.values())
            if tag is not None:
                found.append(self.lattice.cleaned(inner.frame.agg(self.lattice.over_rows(tag)).scalar()))
        frame, output = self.b.frame(plan), items(plan.output())
        tag = self.join(found)
        if tag is None:
            return Node(frame, output)
        node = self._named(frame, [self.b.column(a) for a in output], {0: tag}, output)
        return Node(node.frame, output, {key(a): node.tags[0] for a in output})

    def _sources(self, plan) -> list:
        if kind(plan) == "SubqueryAlias" and plan.alias() in labels.REGISTRY:
            return [plan]
        if kind(plan) == "CTERelationRef":
            return self._sources(self.ctes[plan.cteId()])
        if kind(plan) == "WithCTE":
            for d in items(plan.cteDefs()):
                self.ctes[d.id()] = d.child()
            return self._sources(plan.plan())
        return [s for c in (*items(plan.children()), *items(plan.subqueries())) for s in self._sources(c)]


def track(
    df: DataFrame, lattice: Lattice = BOOL_OR, distinct: str = "values", implicit: str = "log", coarse: bool = True
):
    """Track a DataFrame built from labelled ones; see `provenant.operators.frame.Tracked`.

    `distinct`: "values" joins the tags of equal values, "cells" keeps rows of unequal tags
    apart.  `implicit`: what predicates tell is ignored ("off"), logged ("log") or joined to
    all cells ("strict").  `coarse`: where tags can't be told by cell, one tag for the table
    instead of an error.
    """
    from ..operators.frame import Tracked

    walker = Walker(df.sparkSession, lattice, distinct, implicit, coarse)
    node = walker.walk(analyzed(df))
    return Tracked(df.schema, node, walker)
