"""URL filter, personal data and chat formatting."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import op01_url_filter as urls
from quern.llm import op02_pii as pii
from quern.llm import op10_chat as chat

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"), ("block", "example.com/en/7/x/"), ("allow", "com/en/"), ("block", "b.example.com")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]


def judge(url, rules, default="allow"):
    host, path = parts(url)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.text), len(r.host), r.verdict == "block"), default=None)
    return host, path, best and best.text, best.verdict if best else default


URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/7", "https://a.b.example.com/en/73/x?y", "http://example.com/en", "http://notexample.com/en/7", "http://x.net/de/8", "http://m.example.net/de/812#t", "ftp://user@org/es/", "http://org?x", "a://b://example.com/en/", "http://example.com/en/7/x/y", "http://b.example.com", "http://b.example.com/q", "http://.com/en/", "http://com/en/" + "p" * 5000, "http://example.com/en/7"]


@pytest.mark.parametrize("limit", [100, 0])
def test_urls(spark, limit):
    rules = [urls.parse_rule(*r) for r in RULES]
    rnd = random.Random(1)
    made = [f"http://{rnd.choice(['', 'a.'])}{rnd.choice(['example.com', 'example.net', 'org', 'b.example.com'])}/{rnd.choice(['en', 'de', 'es'])}{rnd.choice(['', '/', '/7', '/8', '/7/x/'])}" for _ in range(60)]
    rows = list(enumerate(URLS + made))
    df = spark.createDataFrame(rows, "page_id int, url string").withColumns({"host": F.lit(1), "rule": F.lit("x")})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(df, rules, broadcast_rules=limit).collect()}
    assert got == {k: judge(u, rules) for k, u in rows}
    assert urls.filter_urls(df.filter("false"), rules, broadcast_rules=limit).isEmpty()


def test_bad_rules():
    for bad in (("deny", "a", "/"), ("allow", "", "/"), ("allow", "a", "x")):
        with pytest.raises(ValueError):
            urls.Rule(*bad)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def good(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and pii.luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def by_patterns(t):
    found = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if good(k, m[0])]
    return sorted(found, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    machine, rnd = pii.automaton(), random.Random(2)
    for letters in ("0123 -.+@a", "ab@.-@+ é", "01.", "+1 ()-.2", "0000000000 -1+", "4 -"):
        for _ in range(1500):
            t = "".join(rnd.choice(letters) for _ in range(rnd.randrange(40)))
            assert [s for s in pii.find_spans(t, machine) if s[0] in pii.BASE_KINDS] == by_patterns(t), t


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("see https://bob:pw@example.com/x.", ["url:https://bob:pw@example.com/x", "email:pw@example.com"]),
        ("mailto:bob@x.org", ["url:mailto:bob@x.org", "email:bob@x.org"]),
        ("Account no. 12345678, ok", ["account:12345678"]),
        ("iban: DE89 3704 0044 0532 0130 00 ok", ["account:DE89 3704 0044 0532 0130 00"]),
        ("account of 12 people at https://example.com/a", []),
        ("accounts 123456", []),
        ("account" + " " * 500 + ": 12345678", ["account:12345678"]),
    ],
)
def test_more_spans(text, wanted):
    assert [f"{k}:{text[a:b]}" for k, a, b in pii.find_spans(text, pii.automaton())] == wanted


def test_personal_data_table(spark):
    long = "x " * 200_000 + "a@b.co"
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "é a@b.co 10.0.0.1", 1), (3, "é a@b.co 10.0.0.1", 1), (4, long, 1)], "doc_id int, text string, spans int")
    got = sorted((r["doc_id"], [tuple(s) for s in r["spans"]]) for r in pii.find_personal_data(df).collect())
    assert got == [(1, []), (2, []), (3, [("email", 2, 8), ("ip", 9, 17)]), (3, [("email", 2, 8), ("ip", 9, 17)]), (4, [("email", 400_000, 400_006)])]
    assert pii.redact("é a@b.co!", [("email", 2, 8)]) == "é [EMAIL]!"
    assert pii.find_personal_data(df.filter("false")).isEmpty()


def best_roles(rows):
    """Brute force over all roles of a conversation's lines."""
    seen = [chat.observe(t, m) for t, m in rows]
    lines = [(e, bool(s)) for emission, turns, _ in seen for e, s in zip(emission, turns)]

    def score(path):
        total = chat.GIVEN.start[path[0]] + lines[0][0][path[0]]
        for k in range(1, len(path)):
            total += (chat.GIVEN.follow if lines[k][1] else chat.STAY)[path[k - 1]][path[k]] + lines[k][0][path[k]]
        return total

    return max(itertools.product(range(3), repeat=len(lines)), key=score)


def flat(rows):
    return [(r["turn"], r["part"], r["role"], r["text"]) for r in rows]


def test_roles_across_segments(spark, monkeypatch):
    rnd = random.Random(3)
    makers = [lambda: "short one?", lambda: "word " * rnd.randrange(20, 150), lambda: "User: hi there", lambda: "ok\nAssistant: sure\nmore"]
    for marks in (False, True):
        rows = [(k * 30, rnd.choice(makers)(), rnd.choice(["user", "assistant", "who", None]) if marks else None) for k in range(6)]  # two or three turns a segment
        df = spark.createDataFrame([(None, *r) for r in rows] + [("c", *r) for r in rows], "conv_id string, turn int, text string, role string")
        want = [chat.ROLES[k] for k in best_roles([(t, m) for _, t, m in rows])]
        for conv in (None, "c"):
            got = chat.format_chats(df, mark=F.col("role")).filter(F.col("conv_id").eqNullSafe(conv)).orderBy("turn", "part").collect()
            assert [r["role"] for r in got for _ in r["text"].split("\n")] == want


@pytest.mark.parametrize("turn", [None, 0])
def test_rows_of_one_turn_are_cut(spark, monkeypatch, turn):
    from quern.llm import shared

    cuts = []
    monkeypatch.setattr(chat, "written", lambda df: cuts.append(shared.written(df)) or cuts[-1], raising=False)
    monkeypatch.setattr(chat, "SEGMENT", 4)
    monkeypatch.setattr(chat, "FAN", 3, raising=False)
    rnd = random.Random(5)
    texts = [f"{k:04d} " + rnd.choice(["short one?", "word " * rnd.randrange(20, 150), f"ok\nAssistant: {k:04d} sure\nmore", f"fine\nUser: {k:04d} hi there"]) for k in range(600)]
    df = spark.createDataFrame([("c", turn, t) for t in rnd.sample(texts, 600)] + [("d", turn, "same")] * 300, "conv_id string, turn long, text string").repartition(5)
    got = chat.format_chats(df).collect()
    assert sum(r["conv_id"] == "d" for r in got) == 300
    # every part holds its row's number: the roles of all lines in order have the best score there is
    said = sorted((re.search("[0-9]{4}", r["text"])[0], r["part"], r["role"], r["text"]) for r in got if r["conv_id"] == "c")
    path = [chat.ROLES.index(role) for _, _, role, text in said for _ in text.split("\n")]
    seen = [chat.observe(t, None) for t in texts]
    emission, turns = np.concatenate([p[0] for p in seen]), np.concatenate([p[1] for p in seen])
    assert [x for _, _, _, text in said for x in text.split("\n")] == [x for p in seen for x in p[2]]
    score = chat.GIVEN.start[path[0]] + emission[0][path[0]]
    for k in range(1, len(path)):
        score += (chat.GIVEN.follow if turns[k] else chat.STAY)[path[k - 1]][path[k]] + emission[k][path[k]]
    assert abs(score - chat.transfer(emission, turns, True)[0].max()) < 1e-6
    sizes = cuts[0].filter("conv = '=c' and place >= 0").groupBy("part", "segment").count().collect()
    assert max(r["count"] for r in sizes) == 4 and max(r["segment"] for r in sizes) >= 9  # three levels


def test_markers_and_rendering(spark):
    text = "### Human: What is it?\nplease\n[assistant] It is so.\n<|system|>\nBe kind."
    row = chat.format_chats(spark.createDataFrame([(1, 0, text)], "conv_id int, turn long, text string")).orderBy("part").collect()
    assert [(r["role"], r["text"]) for r in row] == [("user", "What is it?\nplease"), ("assistant", "It is so."), ("system", "\nBe kind.")]
    assert row[0]["rendered"] == "<|user|>\nWhat is it?\nplease\n<|end|>\n"
    assert [chat.marker(s)[0] for s in ("User: x", "A: yes", "A man", "user", "Note: x", "**Bot**: y")] == [1, 2, -1, -1, -1, 2]


def test_odd_conversations(spark):
    df = spark.createDataFrame([(1, None, None, "user"), (1, 5, "", "user"), (1, 5, "", "user"), (2, 0, "y" * 300_000, None)], "conv_id int, turn long, text string, role string")
    got = chat.format_chats(df, mark=F.col("role")).collect()
    assert len(got) == 4 and sorted(r["turn"] is None for r in got) == [False, False, False, True]
    assert chat.format_chats(df.filter("false"), mark=F.col("role")).isEmpty()


def plain_roles(texts, model):
    """Viterbi over all lines of one conversation: roles of its lines, row by row."""
    seen = [chat.observe(t, None, model) for t in texts]
    score, back = None, []
    for emission, turns, _ in seen:
        for e, change in zip(emission, turns):
            if score is None:
                score = [model.start[r] + e[r] for r in range(3)]
                continue
            table = model.follow if change else chat.STAY
            best = [max(range(3), key=lambda q: score[q] + table[q][r]) for r in range(3)]
            back.append(best)
            score = [score[best[r]] + table[best[r]][r] + e[r] for r in range(3)]
    path = [max(range(3), key=lambda r: score[r])]
    for best in reversed(back):
        path.append(best[path[-1]])
    path = [chat.ROLES[r] for r in path[::-1]]
    return [[path.pop(0) for _ in lines] for _, _, lines in seen]


def test_query_equals_plain_viterbi(spark, sf_dir):
    from quern.llm.queries import QUERIES

    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # some hundred rows
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    held_out = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 == 0
    model = chat.learn(df, ~held_out)
    assert not np.allclose(model.follow, chat.GIVEN.follow)
    got = {}
    for r in QUERIES["op10_chat_format"](spark, sf_dir).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append((r["part"], r["role"], r["text"], r["rendered"], r["held_out"]))
    rows = sorted((r["conv_id"], r["turn"], r["text"], r["role"]) for r in df.collect())
    assert len({r[:2] for r in rows}) == len(rows)
    right = {True: [], False: []}
    for conv, own in itertools.groupby(rows, key=lambda r: r[0]):
        own = list(own)
        for (_, turn, text, truth), roles in zip(own, plain_roles([r[2] for r in own], model)):
            parts = sorted(got.pop((conv, turn)))
            assert [role for _, role, said, _, _ in parts for _ in said.split("\n")] == roles
            assert "\n".join(said for _, _, said, _, _ in parts) == text and all(x == chat.render(r, t) for _, r, t, x, _ in parts)
            right[parts[0][4]].append(roles[0] == truth)
    assert not got and len(right[True]) > 50
    print("accuracy", np.mean(right[True]), np.mean(right[False]))
    assert np.mean(right[True]) > 0.9 and np.mean(right[False]) > 0.9


def test_marked_transcripts_of_the_given_conversations(spark, sf_dir):
    """Turns joined into one transcript for each conversation, each with a marker in one of several spellings."""
    spelt = {"user": ["User: ", "### Human: ", "[user] ", "Q: ", "<|im_start|>user\n"], "assistant": ["Assistant: ", "**Bot**: ", "[assistant] ", "A: ", "<|assistant|>\n"], "system": ["System: ", "### Instruction:\n", "[system] ", "sys: ", "<|system|>\n"]}
    rnd, said = random.Random(4), {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/conversations.parquet").collect(), key=lambda r: (r["conv_id"], r["turn"])):
        said.setdefault(r["conv_id"], []).append((r["role"], rnd.choice(spelt[r["role"]]) + r["text"]))
    df = spark.createDataFrame([(c, 0, "\n".join(t for _, t in turns)) for c, turns in said.items()], "conv_id long, turn long, text string")
    got = {}
    for r in chat.format_chats(df).orderBy("conv_id", "part").collect():
        got.setdefault(r["conv_id"], []).append(r["role"])
    merged = {c: [role for role, _ in itertools.groupby(role for role, _ in turns)] for c, turns in said.items()}
    assert sum(got[c] == merged[c] for c in said) >= 0.97 * len(said)


def test_learning_takes_odd_rows(spark):
    df = spark.createDataFrame([(None, 0, "a", "user"), (1, None, None, "user"), (1, 1, "b", "assistant"), (1, 2, "c", "who"), (2, 0, "d", None)], "conv_id long, turn long, text string, role string")
    model = chat.learn(df, F.lit(True))
    assert model.follow[1, 2] > chat.GIVEN.follow[1, 2] and np.allclose(np.exp(model.kinds).sum(axis=1), 1)
    assert np.allclose(chat.learn(df.filter("false"), F.lit(True)).start, chat.GIVEN.start - np.log(np.exp(chat.GIVEN.start).sum()))


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, 0, "User: a", 5, "x", 1, "y")], "conv_id int, turn int, text string, part int, conv string, segment int, kind string")
    assert [(r["conv_id"], r["part"], r["role"], r["text"]) for r in chat.format_chats(df).collect()] == [(1, 0, "user", "a")]
