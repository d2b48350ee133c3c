"""Chat formatting: round trips, spans, masks, long conversations over many tasks, templates that rewrite."""

import hashlib
import random

import pytest

from corvine.llm import chat as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, digest string, part int, spans string"
NASTY = [None, "", "</s>", "[INST]", "[\\INST] \\ [/INST]", "<<SYS>> x <</SYS>>", "<\\\\s>", "<", "[", "[/", "</", " </s", "", "é\U0001f600\n", "a[/TURN]", "[ROLE]b[/ROLE]", C.TRAP]


def conversations(seed=1, n=40):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", None, "</s>[ROLE]", "User"])
            out.append((c, t, role, "".join(rng.choice(NASTY) or "" for _ in range(rng.randint(0, 3))) or rng.choice(NASTY)))
    rng.shuffle(out)
    return out


ODD = [
    (None, 0, "user", "no id"),
    (None, None, "assistant", "no id, no turn"),
    (1, None, None, None),
    (1, 3, "assistant", "tie b"),
    (1, 3, "assistant", "tie a"),
    (1, 3, "assistant", "tie a"),
    (2, -5, "assistant", "x" * 100_000),
    (3, 0, "user", ""),
]
#: A third of all rows in one conversation.
HOT = [(7, t, ("user", "assistant")[t % 2], f"turn {t} " * (t % 5)) for t in range(900)] + [(t, 0, "user", "x") for t in range(1000, 2800)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "s") for r in rows], SCHEMA)


def in_order(rows):
    key = lambda x: (x is not None, x if x is not None else 0)
    text = lambda x: (x is not None, x or "")
    out = {}
    for c, t, r, x in sorted(rows, key=lambda y: (key(y[0]), key(y[1]), text(y[2]), text(y[3]))):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def slow(rows):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = []
    for c, turns in in_order(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(C.render_inst(turns))))
    return sorted(out, key=repr)


@pytest.fixture(params=["random", "odd", "hot", "empty"])
def rows(request):
    return {"random": conversations(), "odd": ODD, "hot": HOT, "empty": []}[request.param]


def test_read_back(spark, rows):
    got = C.read_back(C.with_trap(spark, table(spark, rows)))
    rows = [*rows, (-7, 0, "user", C.TRAP), (-7, 1, "assistant", C.TRAP)]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == slow(rows)


def test_parts_and_spans(spark, rows, monkeypatch):
    monkeypatch.setattr(C, "PART_CHARS", 500)  # in this process only; workers keep theirs
    want = in_order(rows)
    got = {}
    for r in sorted(C.format_conversations(table(spark, rows)).collect(), key=lambda r: r["part"]):
        so_far, turns = got.setdefault(r["conv_id"], ("", []))
        assert r["start"] == len(so_far) and r["n_turns"] == len(r["spans"]) and r["rewrites"] is None
        assert [s["start"] for s in r["spans"]] == [0, *[s["end"] for s in r["spans"]][:-1]] and r["spans"][-1]["end"] == len(r["text"])
        turns += [(s["role"], C.unescape(r["text"][s["text_start"] : s["text_end"]])) for s in r["spans"]]
        got[r["conv_id"]] = (so_far + r["text"], turns)
    assert got == {c: (C.render_inst(turns), turns) for c, turns in want.items()}


@pytest.mark.parametrize("tasks", [1, 3, 40])
def test_any_cut_into_tasks(tasks):
    """The two functions that tasks run, over every way to deal a conversation: the same result."""
    turns = [(5, t, ("user", "tool", "assistant")[t % 3], f"text {t}") for t in range(40)]
    render = C._format_task(C.INST)

    def deal(rows):
        import pyarrow as pa

        cut = [len(rows) * k // tasks for k in range(tasks + 1)]
        for a, b in zip(cut, cut[1:]):
            columns = zip(*rows[a:b])
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["a", "b", "c", "d"])
            yield from (r for out in render([batch]) for r in out.to_pylist())

    parts = list(C._joined(iter(list(deal(turns))), C.INST))
    assert "".join(p["text"] for p in parts) == C.render_inst([t[2:] for t in turns])
    assert [p["start"] for p in parts] == [sum(len(q["text"]) for q in parts[:k]) for k in range(len(parts))]


def test_escapes_are_undone():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "[", "\\", "/", "s>", "INST]", "<SYS>>", "</SYS>>", "/s>", "ROLE]", " ", "a"]) for _ in range(rng.randint(0, 8)))
        made = C.escape(text)
        assert C.unescape(made) == text and not any(c in made for c in C.CONTROLS)
    assert C.escape("plain \\ text") == "plain \\ text"


def test_rewriting_is_found(spark):
    # keeps what stands before ::: in the last turn alone, as templates do that drop earlier reasoning
    last_thought = lambda turns: "".join(f"<{r}>{t if k == len(turns) - 1 else t.split(':::')[-1]}" for k, (r, t) in enumerate(turns))
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "why:::a"), (1, 2, "user", "more"), (1, 3, "user", "x"), (2, 0, "user", "q"), (2, 1, "assistant", "a")]
    got = {r["conv_id"]: r for r in C.format_conversations(table(spark, rows), C.Template(last_thought)).collect()}
    assert got[1]["rewrites"] == 2 and got[1]["text"] == "<user>q<assistant>a<user>more<user>x"
    assert [(s["role"], got[1]["text"][s["text_start"] : s["text_end"]]) for s in got[1]["spans"]] == [("user", "x")]
    assert got[2]["rewrites"] is None and len(got[2]["spans"]) == 2


def test_a_lookback_that_does_not_hold(spark):
    numbered = lambda turns: "".join(f"{k}:{r}:{t}\n" for k, (r, t) in enumerate(turns))
    rows = table(spark, [(c, t, "user", "x") for c in range(30) for t in range(4)])
    assert C.format_conversations(rows, C.Template(numbered)).first()["text"].endswith("3:user:x\n")
    with pytest.raises(Exception, match="lookback"):
        C.format_conversations(rows, C.Template(numbered, lookback=1)).collect()


def test_texts_that_change_the_marks():
    render = C.Renderer(C.Template(lambda turns: "".join(f"{len(t)}|{t}|" for _, t in turns)), [], 0)
    render.add(("user", "abc"))
    assert render.text == "3|abc|" and render.spans == [("user", 0, 6, None, None)]


def test_sql(spark, tmp_path):
    """The query's SQL on texts and roles that look like marks."""
    import duckdb

    from corvine.llm.queries import ORACLE, QUERIES

    rows = [(c, t, r, x) for c, t, r, x in [*conversations(3), *ODD]]
    table(spark, rows).select("conv_id", "turn", "role", "text").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = QUERIES["op12_chat"](spark, str(tmp_path))
    want = con.execute(ORACLE["op12_chat"])
    names = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
