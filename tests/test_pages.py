"""Recorded pages as rows against a plain replay."""

import copy
import json
import random

import pytest

from tracewell.operators import dom


class Mirror:
    """A page played event by event, node by node."""

    def __init__(self):
        self.nodes = {}

    def put(self, node, parent, next_=None):
        self.drop(node["id"])
        if parent is not None and parent not in self.nodes:
            return
        below = self.nodes[parent]["below"] if parent is not None else None
        if below is not None:
            below.insert(below.index(next_) if next_ in below else len(below), node["id"])
        self.nodes[node["id"]] = {"tag": node["tagName"].lower() if node["type"] == 2 else None, "text": node.get("textContent", ""), **{c: node.get("attributes", {}).get(c) for c in ("class", "href")}, "parent": parent, "below": []}
        for c in node.get("childNodes", []):
            self.put(c, node["id"])

    def drop(self, i):
        n = self.nodes.pop(i, None)
        if n:
            if n["parent"] in self.nodes:
                self.nodes[n["parent"]]["below"].remove(i)
            for c in list(n["below"]):
                self.drop(c)

    def play(self, e):
        """What the event names that isn't there."""
        d, bad = e["data"], []
        if e["type"] == 2:
            self.nodes.clear()
            self.put(d["node"], None)
        elif d["source"] == 0:
            bad += [("remove", x["id"]) for x in d.get("removes", []) if x["id"] not in self.nodes]
            for x in d.get("removes", []):
                self.drop(x["id"])
            for x in d.get("adds", []):
                self.put(x["node"], x["parentId"], x.get("nextId"))
            bad += [("add", x["node"]["id"]) for x in d.get("adds", []) if x["parentId"] not in self.nodes]
            for kind, key in (("texts", "text"), ("attributes", "attributes")):
                for x in d.get(kind, []):
                    if x["id"] not in self.nodes:
                        bad.append((key, x["id"]))
                    elif kind == "texts":
                        self.nodes[x["id"]]["text"] = x["value"]
                    else:
                        self.nodes[x["id"]] |= x["attributes"]
        elif d.get("id") not in self.nodes:
            bad.append(("refer", d.get("id")))
        return bad

    def target(self, i):
        """(tag, class, followed address, shown text) of an element."""
        n = self.nodes.get(i)
        if n is None or n["tag"] is None:
            return None, None, None, None
        href, at = n["href"], self.nodes.get(n["parent"])
        while href is None and at and at["tag"]:
            href = at["href"] if at["tag"] in ("a", "area") else None
            at = self.nodes.get(at["parent"])
        text = " ".join(self.shown(i).split())
        if len(text) > 80:
            kept = text[:79]
            text = (kept.rsplit(" ", 1)[0] if " " in kept else kept) + "…"
        return n["tag"], n["class"], href, text or None

    def shown(self, i):
        n = self.nodes[i]
        if n["tag"] in dom.UNSHOWN:
            return ""
        return (n["text"] if n["tag"] is None else "") + "".join(map(self.shown, n["below"]))


def recording(seed, visitors=5, events=70, deep=0):
    """(rows for a table, visitor -> its events): pages that grow, move, lose subtrees and change, with clicks all over, some on what is gone."""
    r = random.Random(seed)
    ids = iter(range(1, 10**6))
    words = "alpha beta gamma delta the a of".split()

    def leaf():
        return {"type": 3, "id": next(ids), "textContent": r.choice(["", " ", "\n"]) + " ".join(r.choices(words, k=r.randrange(6))) + r.choice(["", " "])}

    def grown(depth):
        node = {"type": 2, "id": next(ids), "tagName": r.choice(["DIV", "a", "EM", "li", "SPAN", "script"] if r.random() < 0.3 else ["DIV", "a", "EM", "li"]), "attributes": {}, "childNodes": []}
        if r.random() < 0.6:
            node["attributes"]["class"] = f"c{r.randrange(9)}"
        if node["tagName"] == "a" and r.random() < 0.7:
            node["attributes"]["href"] = f"/h{r.randrange(99)}"
        if depth:
            node["childNodes"] = [leaf() if r.random() < 0.4 else grown(depth - 1) for _ in range(r.randrange(4))]
        return node

    rows, played = [], {}
    for v in range(visitors):
        mirror, log, known = Mirror(), [], []
        for t in range(events):
            lives = list(mirror.nodes)
            elements = [i for i in lives if mirror.nodes[i]["tag"]]
            if t == 0 or r.random() < 0.03:
                body = {"type": 0, "id": next(ids), "childNodes": [grown(4) for _ in range(3)]}
                if deep:
                    top = body
                    for _ in range(deep):
                        top["childNodes"].append({"type": 2, "id": next(ids), "tagName": r.choice(["a", "DIV", "DIV"]), "attributes": {}, "childNodes": []})
                        top = top["childNodes"][-1]
                    top["childNodes"] = [leaf()]
                e = {"type": 2, "data": {"node": body}}
            elif r.random() < 0.5 and elements:
                d = {"source": 0, "removes": [], "adds": [], "texts": [], "attributes": []}
                for _ in range(r.randrange(1, 4)):
                    kind, i = r.random(), r.choice(lives)
                    if kind < 0.25:
                        d["removes"].append({"id": i, "parentId": mirror.nodes[i]["parent"]})
                    elif kind < 0.6:
                        up = r.choice(elements)
                        d["adds"].append({"parentId": up, "nextId": r.choice([None, *mirror.nodes[up]["below"]]), "node": leaf() if r.random() < 0.4 else grown(2)})
                    elif kind < 0.8:
                        d["texts"].append({"id": i, "value": " ".join(r.choices(words, k=3))}) if mirror.nodes[i]["tag"] is None and mirror.nodes[i]["parent"] is not None else None
                    else:
                        d["attributes"].append({"id": i, "attributes": r.choice([{"class": f"m{t}"}, {"href": f"/n{t}"}, {"href": None}])}) if mirror.nodes[i]["tag"] else None
                e = {"type": 3, "data": d}
            else:
                e = {"type": 3, "data": {"source": 2, "type": 2, "id": r.choice(known)}}
            # one removal an event and no change of what goes, as recorders have it
            if e["data"].get("removes"):
                e["data"]["removes"] = e["data"]["removes"][:1]
                gone = Mirror()
                gone.nodes = json.loads(json.dumps(mirror.nodes), object_hook=lambda x: {int(k) if k.isdigit() else k: y for k, y in x.items()})
                gone.drop(e["data"]["removes"][0]["id"])
                left = set(gone.nodes)
                e["data"]["adds"] = [x for x in e["data"]["adds"] if x["parentId"] in left and (x["nextId"] is None or x["nextId"] in left)]
                e["data"]["texts"] = [x for x in e["data"]["texts"] if x["id"] in left]
                e["data"]["attributes"] = [x for x in e["data"]["attributes"] if x["id"] in left]
            bad = mirror.play(e)
            known = sorted({*known[-200:], *mirror.nodes})
            log.append((v * 1000 + t, e, mirror.target(e["data"].get("id")), bad))
            rows.append((v * 1000 + t, f"v{v}", "s", t // 3, f"{t:019d}", e["type"], json.dumps(e), e["data"].get("id")))
        played[f"v{v}"] = log
    return rows, played


KIND = "id long, visitor_id string, recorder_slice string, timestamp long, counter string, type int, raw string, target_id long"


@pytest.mark.parametrize(("seed", "deep"), [(7, 0), (8, 100)])
def test_targets_equal_a_replay(spark, seed, deep):
    """Tag, class, address and text of every click's target, with subtrees that go, at a depth of 100 as well; and what is named but isn't there."""
    rows, played = recording(seed, deep=deep)
    df = dom.with_epochs(spark.createDataFrame(rows, KIND))
    told = dom.nodes(df).cache()
    lives = dom.lifetimes(told).cache()
    clicks = df.where("target_id is not null").drop("raw", "type")
    out = dom.with_text(dom.followed(clicks, told, lives), told, lives)
    got = {x["id"]: (x["tag"], x["class"], x["href"], x["text"]) for x in out.collect()}
    want = {i: target for log in played.values() for i, e, target, _ in log if e["type"] == 3 and e["data"]["source"] == 2}
    assert got == want
    assert sum(x[2] is not None for x in got.values()) > 2 and sum(x[3] is not None for x in got.values()) > 20 and sum(x[0] is None for x in got.values()) > 5
    times = {x["id"]: x["at"] for x in df.collect()}
    bad = {(x["visitor_id"], x["at"], x["said"], x["node_id"]) for x in dom.unresolved(told, lives).collect()}
    assert bad == {(v, times[i], said, node) for v, log in played.items() for i, _, _, faults in log for said, node in faults}
    if deep:
        alive = lives.where("ends > born").groupBy(*dom.PAGE).count().agg({"count": "max"}).first()[0]
        assert alive > 100


def test_a_removed_parent_takes_all_below(spark):
    chain = {"type": 2, "id": 300, "tagName": "B", "attributes": {}, "childNodes": []}
    for i in range(299, 1, -1):
        chain = {"type": 2, "id": i, "tagName": "A" if i == 5 else "P", "attributes": {"href": "/x"} if i == 5 else {}, "childNodes": [chain]}
    events = [{"type": 2, "data": {"node": {"type": 0, "id": 1, "childNodes": [chain]}}}, {"type": 3, "data": {"source": 2, "id": 300}}, {"type": 3, "data": {"source": 0, "removes": [{"id": 40}]}}, {"type": 3, "data": {"source": 2, "id": 300}}]
    df = dom.with_epochs(spark.createDataFrame([(k, "v", "s", k, str(k), e["type"], json.dumps(e), e["data"].get("id")) for k, e in enumerate(events)], KIND))
    told = dom.nodes(df)
    out = {x["id"]: (x["tag"], x["href"]) for x in dom.followed(df.where("target_id is not null"), told).collect()}
    assert out == {1: ("b", "/x"), 3: (None, None)}
    assert dom.lifetimes(told).where("ends > 3").count() == 39


def test_slices_that_name_what_is_not_there_are_refused(spark):
    """Each orphan against a plain replay of the slice before it and the orphans between."""
    refused = {}
    rows, runs = [], []
    for seed in range(6):
        own, played = recording(100 + seed, visitors=1, events=40)
        v = f"w{seed}"
        mirror = Mirror()
        for k, (row, (_, e, _, _)) in enumerate(zip(own, played["v0"], strict=True)):
            slice_ = "a" if k < 20 else "b" if k < 30 else "c"
            if e["type"] == 2 and slice_ != "a":
                e = {"type": 3, "data": {"source": 3, "id": next(iter(mirror.nodes), 1)}}
            if seed % 2 == 0 and copy.deepcopy(mirror).play(e):  # of every other visitor all is there
                e = {"type": 3, "data": {"source": 3, "id": next(iter(mirror.nodes), 1)}}
            bad = mirror.play(e)
            if bad and slice_ != "a" and (v, slice_) not in refused:
                refused[v, slice_] = row[3], {node for _, node in bad}
            rows.append((seed * 10_000 + k, v, slice_, row[3], row[4], e["type"], json.dumps(e), None))
        runs += [(v, "b", "a"), (v, "c", "a")]
    df = spark.createDataFrame(rows, KIND)
    out = {(x["visitor_id"], x["recorder_slice"]): x for x in dom.refusals(df, spark.createDataFrame(runs, "visitor_id string, recorder_slice string, into string")).collect()}
    assert set(out) == set(refused) and 0 < len(refused) < 12
    for key, (at, names) in refused.items():
        assert out[key]["refused_at"] == at and int(out[key]["reason"].rsplit(" ", 1)[1]) in names and out[key]["reason"].startswith(f"at {at}: ")


def test_broken_trees_do_no_harm(spark):
    odd = ["", "{", "[]", '{"type":2}', '{"type":2,"data":{"node":{"id":"x"}}}', '{"type":3,"data":{"source":0,"adds":[1,{"node":{"id":4,"type":2,"tagName":"P","attributes":3}}],"attributes":[{"id":4}],"removes":[{}],"texts":7}}', None, '{"type":3,"data":{"source":1,"positions":[{"id":9},3],"id":true}}']
    df = spark.createDataFrame([(k, "v", "s", k, str(k), 3, x) for k, x in enumerate(odd)], "id long, visitor_id string, recorder_slice string, timestamp long, counter string, type int, raw string")
    told = dom.nodes(dom.with_epochs(df))
    assert {(x["node_id"], x["said"]) for x in told.collect()} == {(4, "add"), (4, "attributes"), (9, "refer")}
    assert dom.lifetimes(told.limit(0)).count() == 0


NODES = "visitor_id string, recorder_slice string, epoch long, at long, timestamp long, node_id long, tag string, class string, href string, value string, parent long, next long, kind int, place int, said string"


def test_pages_without_nodes_and_nodes_above_themselves(spark):
    """Clicks on pages of which nothing was told find nothing; nodes that were added below themselves, or below each other in one event, never live."""
    own = {"type": 3, "data": {"source": 0, "adds": [{"parentId": 9, "node": {"type": 2, "id": 9, "tagName": "A"}}]}}
    each = {"type": 3, "data": {"source": 0, "adds": [{"parentId": 6, "node": {"type": 2, "id": 5, "tagName": "A"}}, {"parentId": 5, "node": {"type": 2, "id": 6, "tagName": "B", "childNodes": [{"type": 3, "id": 7, "textContent": "x"}]}}]}}
    rows = [(k, "v", "s", k, str(k), e["type"], json.dumps(e), None) for k, e in enumerate([{"type": 2, "data": {"node": {"type": 0, "id": 1}}}, own, each])]
    rows += [(10 + k, v, "s", 10, str(10 + k), 3, None, target) for k, (v, target) in enumerate([("v", 9), ("v", 6), ("v", 1), ("w", 1), ("w", None)])]
    df = dom.with_epochs(spark.createDataFrame(rows, KIND))
    told = dom.nodes(df)
    assert {x["node_id"]: x["ends"] > x["born"] for x in dom.lifetimes(told).collect()} == {1: True, 5: False, 6: False, 7: False, 9: False}
    out = dom.seen(df.where("raw is null"), told)
    assert [(x["id"], x["tag"], x["class"], x["href"], x["text"]) for x in out.orderBy("id").collect()] == [(k, None, None, None, None) for k in range(10, 15)]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_nodes_move_once(spark):
    """One shuffle brings all that was told of a page together, with clicks or without, and nothing is written down between."""
    told = spark.createDataFrame([], NODES)
    clicks = spark.createDataFrame([], "id long, visitor_id string, recorder_slice string, epoch long, at long, target_id long")
    for out in (dom.lifetimes(told), dom.followed(clicks, told), dom.with_text(clicks, told), dom.seen(clicks, told), dom.unresolved(told)):
        assert shuffles(out) == 1
        assert out.count() == 0


def test_a_page_over_many_batches_and_many_pages_in_one(spark):
    """A page of 30,000 nodes between small ones: the task's batches break within it. An element with many texts shows the first of them."""
    leaves = [{"type": 3, "id": 10 + k, "textContent": f" t{k}" if k > 20_000 else " "} for k in range(30_000)]
    big = {"type": 2, "data": {"node": {"type": 0, "id": 1, "childNodes": [{"type": 2, "id": 2, "tagName": "P", "childNodes": leaves}]}}}
    small = {"type": 2, "data": {"node": {"type": 0, "id": 1, "childNodes": [{"type": 2, "id": 2, "tagName": "P", "childNodes": leaves[-1:]}]}}}
    rows = []
    for v in range(40):
        for k, e in enumerate((big if v in (7, 8, 30) else small, {"type": 3, "data": {"source": 2, "id": 2}})):
            rows.append((2 * v + k, f"v{v:02d}", "s", k, str(k), e["type"], json.dumps(e), 2 if k else None))
    df = dom.with_epochs(spark.createDataFrame(rows, KIND))
    told = dom.nodes(df)
    lives = dom.lifetimes(told).groupBy("visitor_id").count().collect()
    assert {x["visitor_id"]: x["count"] for x in lives} == {f"v{v:02d}": 30_002 if v in (7, 8, 30) else 3 for v in range(40)}
    words = " ".join(f"t{k}" for k in range(20_001, 20_020))
    out = {x["visitor_id"]: x["text"] for x in dom.seen(df.where("target_id is not null"), told).collect()}
    assert out == {f"v{v:02d}": words[:79].rsplit(" ", 1)[0] + "…" if v in (7, 8, 30) else "t29999" for v in range(40)}


@pytest.mark.parametrize(("query", "moves"), [("node_lifetimes", 3), ("refused_slices", 6), ("click_targets", 3)])
def test_queries_move_what_was_told_once(spark, query, moves):
    """Of the shuffles of a query over recorded pages one carries nodes (the others events, and what comes out); no step is written down and read again."""
    from tracewell.plans import catalog, evidence  # noqa: F401

    plan = catalog.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") - plan.count("BroadcastExchange ") <= moves and plan.count("MapInArrow") == 2 and "ExistingRDD" not in plan


def test_what_was_told_in_arrays(spark, monkeypatch):
    """One row an event, with repeated texts and stretches that break within a page: the operators find what they find of rows."""
    monkeypatch.setattr(dom, "TEXTS", 300)
    monkeypatch.setattr(dom, "NODES", 5)
    page = {"type": 2, "data": {"node": {"type": 0, "id": 1, "childNodes": [{"type": 2, "id": 2, "tagName": "A", "attributes": {"href": "/a"}, "childNodes": [{"type": 3, "id": 3, "textContent": "é"}]}, {"type": 2, "id": 4, "tagName": "B"}]}}}
    acts = [
        page,
        {"type": 3, "data": {"source": 0, "texts": [{"id": 3, "value": "now"}], "adds": [{"parentId": 2, "node": {"type": 3, "id": 5, "textContent": " more"}}], "attributes": [{"id": 4, "attributes": {"class": "c"}}]}},
        {"type": 3, "data": {"source": 2, "id": 9}},
        {"type": 3, "data": {"source": 0, "removes": [{"id": 2}, {"id": 8}], "adds": [{"parentId": 7, "node": {"type": 3, "id": 6}}]}},
        {"type": 3, "data": {"source": 0}},
    ]
    rows = [(100 * v + k, f"v{v}", "s", k, f"{k:03d}", e["type"] if e else 3, json.dumps(e) if e else None, t) for v in range(3) for k, (e, t) in enumerate([*((e, None) for e in acts * 2), *((None, t) for t in (2, 3, 4, 9))])]
    rows += [(100 * v + 50 + k, f"v{v}", "s", k, f"{k:03d}a", 3, None, t) for v in range(3) for k in range(10) for t in (2, 4)]
    df = dom.with_epochs(spark.createDataFrame(rows, KIND))
    told, clicks = dom.nodes(df), df.where("target_id is not null").drop("raw", "type")
    as_set = lambda out: sorted(map(str, out.select(*sorted(out.columns)).collect()))
    assert dom.packed(df).count() == 3 * 2 * 4 < told.count()
    for f, need in (
        (lambda x: dom.lifetimes(x), {}),
        (lambda x: dom.lifetimes(x, ("ends", "anchor")), dom.OF_LIVES),
        (lambda x: dom.followed(clicks, x), dom.OF_LINKS),
        (lambda x: dom.with_text(clicks, x), dom.OF_TEXTS),
        (lambda x: dom.seen(clicks, x), dom.OF_BOTH),
        (lambda x: dom.unresolved(x), {}),
    ):
        assert as_set(f(dom.packed(df, **need))) == as_set(f(told)) != []


def outputs(plan):
    out = [plan.output().apply(k) for k in range(plan.output().size())]
    for k in range(plan.children().size()):
        out += outputs(plan.children().apply(k))
    return out


@pytest.mark.parametrize("query", ["node_lifetimes", "click_texts", "refused_slices", "click_targets"])
def test_queries_move_a_row_an_event(spark, query):
    """What was told moves as arrays, so that no node is a row before it comes out."""
    from tracewell.plans import catalog, evidence  # noqa: F401

    plan = catalog.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed()
    assert "array<string>" in {c.dataType().simpleString() for c in outputs(plan) if c.name() == "said"}
