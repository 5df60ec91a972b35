import random
import re

from verifold.llm import quotes


def plain_parse(t):
    lines = []
    for x in re.split("\r?\n", t or ""):
        m = re.match(r"[ \t]*(?:>[ \t]?)+", x)
        p = m[0] if m else ""
        lines.append((p.count(">"), x[len(p) :]))
    norm = lambda b: re.sub("[\x20\x09-\x0d\xa0]+", " ", b.lower()).strip(" ")
    runs, last = [], None
    for level, body in lines:
        if norm(body) == "":
            last = None
            continue
        if last != level:
            runs.append((level, []))
        runs[-1][1].append(norm(body))
        last = level
    units = []
    for level, own in runs:
        units.append((level, " ".join(own)))
        if len(own) > 1:
            units += [(level, b) for b in own]
    return max(x for x, _ in lines), units


def plain_threads(messages):
    """One message at a time, against all earlier ones."""
    parsed = [(c, t, r, x, *plain_parse(x)) for c, t, r, x in messages]
    own = {}
    for c, t, r, x, _, units in parsed:
        if c is not None and t is not None:
            own.setdefault(c, {})[t, x or ""] = {u for level, u in units if level == 0}
    parent = {}
    for c, t, r, x, _, units in parsed:
        if c is None or t is None:
            continue
        found = {}
        for (pt, px), held in own[c].items():
            for level in {level for level, _ in units if level > 0}:
                n = sum(len(u) for u in {u for k, u in units if k == level} & held)
                if n and pt < t:
                    found[level, pt, px] = n
        if found:
            (_, pt, px), _ = max(found.items(), key=lambda kv: (-kv[0][0], kv[1], -kv[0][1]))
            parent[c, t, x] = (pt, px)
    out = []
    for c, t, r, x, top, units in parsed:
        depth, at, root = 0, (t, x), t
        while (c, *at) in parent:
            at = parent[c, *at]
            depth, root = depth + 1, at[0]
        out.append((c, t, r, sum(u[0] > 0 for u in units), top, parent.get((c, t, x), (None,))[0], root, depth))
    return out


def made():
    rnd = random.Random(12)
    out = []
    for c in range(30):
        texts = []
        for t in range(rnd.randrange(1, 9)):
            own = [f"Line {c} {t} {k} said {rnd.randrange(99)}" for k in range(rnd.randrange(1, 4))]
            body = "\n".join(own)
            if texts and rnd.random() < 0.7:
                q = rnd.choice(texts)
                if rnd.random() < 0.3:
                    q = q.split("\n")[0]
                if rnd.random() < 0.3:
                    q = q.upper().replace(" ", "  ")
                body = "On Monday X wrote:\n" + "\n".join("> " + y for y in q.split("\n")) + "\n\n" + body
            texts.append(body)
            out.append((c, t, rnd.choice(["user", "assistant"]), body))
    return out


def test_threads_match_brute_force(spark):
    msgs = made()
    msgs += [(90, 0, "user", None), (90, 1, "user", ""), (90, 2, "user", "> nobody said this"), (None, 0, "user", "> lost"), (91, None, "user", "no turn"), (91, 1, "user", "> no turn"), msgs[3], msgs[3]]
    msgs += [(92, 0, "user", "word\n" * 30000), (92, 1, "user", "> word\nyes")]
    df = spark.createDataFrame([(*m, "x") for m in msgs], "conv_id long, turn long, role string, text string, depth string").repartition(4)
    got = [(r.conv_id, r.turn, r.role, r.n_quotes, r.max_level, r.reply_to_turn, r.root_turn, r.depth) for r in quotes.threads(df).collect()]
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(got, key=key) == sorted(plain_threads(msgs), key=key)
    assert sum(r[5] is not None for r in got) > 40 and max(r[7] for r in got) >= 3


def test_parent_is_the_best_of_all_holders(spark):
    """A long paragraph that many messages end with must not outweigh the message that was quoted."""
    long = "This signature is longer than what is said above it, and everybody's letter ends with it."
    rnd = random.Random(5)
    msgs = [(1, 0, "u", f"Opening.\n\n{long}")]
    for t in range(1, 60):
        ends = [x for x, on in ((long, rnd.random() < 0.8), ("A second line of goodbye.", rnd.random() < 0.5), (f"rare {t % 25}", rnd.random() < 0.5)) if on]
        body = [f"Short {t % 40}", *ends]
        q = msgs[rnd.randrange(len(msgs))][3].split("\n\n")
        back = "\n>\n".join("> " + x for x in q if not x.startswith(">") and (x == q[0] or rnd.random() < 0.8))
        msgs.append((1, t, "u", "\n\n".join([*body, *([back] if back and rnd.random() < 0.8 else [])])))
    df = spark.createDataFrame(msgs, "conv_id long, turn long, role string, text string").repartition(3)
    want = {r[1]: r[5] for r in plain_threads(msgs)}
    for few in (0, 2, 16, 1000):
        links = quotes.reply_links(quotes.parse(df), few).join(quotes.parse(df).select("msg", "turn"), "msg").collect()
        assert {r.turn: r.parent_turn for r in links} == {t: p for t, p in want.items() if p is not None}
    assert len({p for p in want.values() if p}) > 10


def test_links_at_size_with_hot_phrases(spark):
    """Ten thousand messages, a third in one conversation, all of them ending alike; replies quote what they answer."""
    rnd = random.Random(7)
    msgs, truth, bodies = [], {}, {}
    for i in range(10_000):
        c = 0 if i % 3 == 0 else 1 + rnd.randrange(400)
        own = bodies.setdefault(c, [])
        t, body = len(own), f"Message {c} {len(own)} says {rnd.randrange(10**6)}"
        own.append(body)
        text = body + "\n\nSent from my desk."
        if t and rnd.random() < 0.7:
            p = rnd.randrange(t)
            truth[c, t] = p
            text = f"> {own[p].upper()}\n>\n> Sent from my desk.\n\n" + text
        msgs.append((c, t, "user", text))
    got = quotes.threads(spark.createDataFrame(msgs, "conv_id long, turn long, role string, text string").repartition(8)).collect()
    assert len(got) == len(msgs) and {(r.conv_id, r.turn): r.reply_to_turn for r in got if r.reply_to_turn is not None} == truth
    place = {(r.conv_id, r.turn): k for k, r in enumerate(got)}
    assert all(place[c, p] < place[c, t] for (c, t), p in truth.items())


def test_order_bodies_and_nested_levels(spark):
    msgs = [(1, 0, "a", "First words."), (1, 1, "b", "> First words.\nSecond."), (1, 2, "a", "Other topic."), (1, 3, "c", "On 1 May b wrote:\n> > First words.\n> Second.\nThird."), (1, 4, "d", ">Other topic.\n\nFourth.")]
    rows = quotes.threads(spark.createDataFrame(msgs, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.turn, r.body, r.reply_to_turn, r.root_turn, r.depth) for r in rows] == [
        (0, "First words.", None, 0, 0), (1, "Second.", 0, 0, 1), (3, "Third.", 1, 0, 2), (2, "Other topic.", None, 2, 0), (4, "Fourth.", 2, 2, 1),
    ]


def test_long_chain_and_empty_table(spark):
    n = 70
    msgs = [(1, t, "u", (f"> own {t - 1}\n" if t else "") + f"own {t}") for t in range(n)]
    rows = quotes.threads(spark.createDataFrame(msgs, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.turn, r.depth, r.root_turn) for r in rows] == [(t, t, 0) for t in range(n)]
    assert quotes.threads(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_native_plan(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    plan = quotes.parse(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
