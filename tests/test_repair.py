"""Tables of operations judged many at a time, against the rules taken one by one."""

import random

import pytest

from kgspark import schemas
from kgspark.operators import hierarchy as H
from kgspark.operators.repair import replay, spanning_forest
from kgspark.plans.star import make_ontology
from kgspark.skew import SkewPolicy
from kgspark.storage import local_table

ARITY = {"merge": 2, "bridge": 2, "prune": 1}


def pieces(edges):
    """Number of clusters of a list of relations."""
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[top(a)] = top(b)
    return len({top(x) for x in parent})


def one_by_one(edges, objects, data, operations):
    """History [(place, error)], relations and property lists."""
    history = []
    for place, (kind, indexes, relations, classes) in enumerate(operations):
        clusters = pieces(edges)
        if clusters <= 1:
            break
        known = {x for e in edges for x in e}
        named = [x for r in relations for x in r] if kind != "prune" else classes
        error = None
        if kind not in ARITY:
            error = "unknown_operation"
        elif len(indexes or []) != ARITY[kind]:
            error = "wrong_arity"
        elif kind != "bridge" and any(x not in known for x in named):
            error = "unknown_class"
        elif any(i is None or not 1 <= i <= clusters for i in indexes):
            error = "unknown_cluster"
        else:
            if kind == "prune":
                new = [e for e in edges if e[0] not in classes and e[1] not in classes]
            else:
                fresh = dict.fromkeys(r for r in relations if None not in r)
                new = edges + [r for r in fresh if r not in edges]
            if pieces(new) >= clusters:
                error = "clusters_not_reduced"
        if error is None:
            edges = new
            related = {x for e in edges for x in e}
            stays = (lambda x: x not in classes) if kind == "prune" else (lambda x: x in related)
            objects = [(n, [x for x in d if stays(x)], [x for x in r if stays(x)]) for n, d, r in objects]
            objects = [p for p in objects if p[1] and p[2]]
            data = [(n, [x for x in d if stays(x)]) for n, d in data]
            data = [p for p in data if p[1]]
        history.append((place, error))
    return history, edges, objects, data


def ops_table(spark, operations):
    return local_table(spark, [
        (i, kind, indexes, [{"subclass": a, "superclass": b} for a, b in relations], classes)
        for i, (kind, indexes, relations, classes) in enumerate(operations)
    ], schemas.OPS)


def check(spark, scratch, edges, objects, data, operations, policy=SkewPolicy()):
    names = sorted({x for e in edges for x in e} | {"Alone"})
    onto = make_ontology(spark, "split", names, edges, objects, data)
    fixed, history = replay(onto, ops_table(spark, operations), scratch, policy)
    log, left, left_objects, left_data = one_by_one(edges, objects, data, operations)
    rows = history.orderBy("op_seq").collect()
    assert [(r["op_seq"], r["error"]) for r in rows] == log
    assert sorted((r["subclass"], r["superclass"]) for r in fixed.subclass_of.collect()) == sorted(left)
    assert sorted((r["name"], r["domain"], r["range"]) for r in fixed.object_properties.collect()) == sorted(left_objects)
    assert sorted((r["name"], r["domain"]) for r in fixed.data_properties.collect()) == sorted(left_data)
    return max((r["round"] for r in rows), default=0), log


def random_case(seed, clusters=8, operations=24):
    rng = random.Random(seed)
    edges, names = [], []
    for c in range(clusters):
        members = [f"C{c}x{i}" for i in range(rng.randint(2, 4))]
        names += members
        edges += [(m, rng.choice(members[:i + 1])) for i, m in enumerate(members[1:])]
    pool = names + ["New1", "New2", "New3", "Alone"]
    rows = []
    for _ in range(operations):
        kind = rng.choices(["merge", "bridge", "prune"], [5, 3, 3])[0]
        from_ = names if rng.random() < 0.8 else pool
        relations = [(rng.choice(from_), rng.choice(from_)) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]
        own = rng.randrange(clusters)
        classes = rng.choice([
            [n for n in names if n.startswith(f"C{own}x")], [rng.choice(pool)], rng.sample(names, 2), [],
        ])
        count = ARITY[kind] if rng.random() < 0.93 else 3
        limit = 3 if rng.random() < 0.6 else clusters + 1
        rows.append((kind, [rng.randint(0 if rng.random() < 0.05 else 1, limit) for _ in range(count)],
                     relations if kind != "prune" else [], classes if kind == "prune" else []))
    objects = [(f"p{i}", rng.sample(pool, 3), rng.sample(pool, 3)) for i in range(6)] + [("none", [], ["Alone"])]
    data = [(f"d{i}", rng.sample(pool, 2)) for i in range(6)]
    return edges, objects, data, rows


@pytest.mark.parametrize("seed", range(2))
def test_replay_equals_one_by_one(spark, scratch, seed):
    policy = SkewPolicy(min_rows=2, rows_per_split=1, max_splits=3, sample=1.0) if seed == 1 else SkewPolicy()
    check(spark, scratch, *random_case(seed), policy=policy)


def test_many_operations_few_rounds(spark, scratch):
    """All bridges share the first cluster, prunes stand behind them: 41 rows in three rounds."""
    edges = [(f"S{i}", f"T{i}") for i in range(40)]
    bridges = [("bridge", [1, 31 - i], [(f"T{30 - i}", "T0")], []) for i in range(30)]
    prunes = [("prune", [1], [], [f"S{i}", f"T{i}"]) for i in range(31, 40)] + [("prune", [1], [], ["S5"])]
    rounds, log = check(spark, scratch, edges, [("p", ["S5", "T0"], ["T39", "S1"])], [("d", ["S35"])], bridges + prunes)
    assert rounds <= 3 and len(log) == 39 and all(error is None for _, error in log)


def test_rows_out_of_the_ordinary(spark, scratch):
    edges = [("A", "R"), ("C", "S"), ("D", "T")]
    operations = [
        ("split", [1], [], []),
        ("merge", None, [("A", "S")], []),
        ("merge", [1, None], [("A", "S")], []),
        ("merge", [1, 2], [(None, "S")], []),
        ("bridge", [1, 2], [(None, "S"), ("A", "X")], []),   # its X does not come
        ("merge", [1, 2], [("X", "C")], []),                  # so X is unknown here
        ("bridge", [1, 2], [("X", "A"), ("X", "C")], []),
        ("merge", [1, 2], [("X", "D"), ("X", "D")], []),
        ("merge", [1, 2], [("A", "D")], []),                  # one piece already
    ]
    _, log = check(spark, scratch, edges, [("p", ["A", "X"], ["D"])], [("d", ["X"])], operations)
    assert len(log) == 8
    onto = make_ontology(spark, "o", ["A"], edges, [], [])
    fixed, history = replay(onto, ops_table(spark, []), scratch)
    assert history.isEmpty() and fixed is onto
    fixed, history = H.fix_ontology(make_ontology(spark, "o", [], [], [], []), scratch, ops_table(spark, operations))
    assert history.isEmpty() and fixed.subclass_of.isEmpty()


def test_spanning_forest(spark, scratch):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", rank) for rank in range(60)]
    parent = {f"n{i}": f"n{i}" for i in range(30)}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    chosen = []
    for a, b, rank in edges:
        if top(a) != top(b):
            parent[top(a)] = top(b)
            chosen.append(rank)
    found = spanning_forest(spark.createDataFrame(edges, "a string, b string, rank long"), scratch)
    assert sorted(r["rank"] for r in found.collect()) == chosen


def test_replay_sends_no_table_through_the_driver(spark, scratch, monkeypatch):
    """All joins are shuffled but those with bounded tables: offsets of partitions, and hot ones of born and died."""
    joins, save = [], type(scratch).save

    def noted(self, df, name="t"):
        plan = df._jdf.queryExecution().executedPlan().toString()
        joins.extend(line for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line)
        return save(self, df, name)

    monkeypatch.setattr(type(scratch), "save", noted)
    edges = [("B", "A"), ("D", "C"), ("F", "E")]
    operations = [("merge", [1, 2], [("A", "C")], []), ("prune", [1], [], ["E"]), ("merge", [1, 2], [("B", "A")], [])]
    _, log = check(spark, scratch, edges, [("p", ["A"], ["D"])], [("d", ["E"])], operations)
    assert log and [line for line in joins if not any(k in line for k in ("[_pid#", "[born#", "[died#"))] == []
