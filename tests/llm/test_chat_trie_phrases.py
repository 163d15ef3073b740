"""Operators 11 to 13 against brute force: event logs, prefix tries, collocations."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import chat, collocations, prefix_trie
from cohortlens.llm.common import Scratch
from cohortlens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NEW = ["op11_prefix_trie", "op12_collocations", "op13_chat_format"]
SIGNS = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "\\", "<", "[", "]", " ", "\n", "s>", "/INST]", "é", "𝒳", "$1", "<\\s>", ""]


@pytest.mark.parametrize("name", NEW)
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    ours = QUERIES[name](spark, SF).toPandas()
    theirs = con.sql(ORACLES[name]).df()[list(ours.columns)]
    key = lambda frame: sorted(map(str, frame.astype(object).where(frame.notna(), None).map(lambda v: int(v) if isinstance(v, (int, float)) else v).values.tolist()))
    assert key(ours) == key(theirs)


# --- chat


def fold_by_hand(events):
    """The contract of fold(), one event after another."""
    order = lambda e: tuple((x is not None, x) for x in e)
    events = sorted(set(events), key=order)
    text, role, opened, gone = {}, {}, [], set()
    for _, kind, m, r, t in events:
        if kind == "message" and m not in text:
            text[m], role[m] = t or "", r or ""
            opened.append(m)
        elif m not in text or kind == "message":
            continue
        elif kind == "delta":
            text[m] += t or ""
        elif kind in ("edit", "regenerate"):
            text[m] = t or ""
            if kind == "regenerate":
                gone |= set(opened[opened.index(m) + 1 :])
    return [(role[m], text[m]) for m in opened if m not in gone]


def test_fold_equals_one_event_after_another(spark):
    random.seed(5)
    logs = {}
    for conv in [None, *range(40)]:
        events = []
        for _ in range(random.randint(1, 25)):
            kind = random.choice(["message", "message", "delta", "delta", "edit", "regenerate", "unknown", None])
            if kind == "unknown" or kind is None:
                continue
            events.append((random.randint(0, 18), kind, random.randint(0, 4), random.choice(["user", "assistant", None]), random.choice(["a", "b c", "", None, "x<s>"])))
        logs[conv] = events + random.sample(events, min(2, len(events)))
    rows = [(c, *e) for c, log in logs.items() for e in log] + [(1, 3, None, 0, "user", "x"), (1, 3, "unknown", 0, "user", "x"), (1, 3, "delta", None, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, seq long, kind string, message long, role string, text string").withColumn("at", F.lit(1))
    found = defaultdict(dict)
    for r in chat.fold(df).collect():
        found[r["conv_id"]][r["place"]] = (r["role"], r["text"])
    for conv, log in logs.items():
        want = fold_by_hand(log)
        assert [found[conv][i] for i in range(len(found[conv]))] == want


def test_formats_read_back(spark):
    random.seed(6)
    texts = lambda: random.choice([None, "", "".join(random.choices(SIGNS, k=random.randint(0, 12)))])
    rows = [(c, random.choice([None, 0, 1, 2, 3, 5]), random.choice(["user", "assistant", "assistant", "system", None, "", "a [/ROLE] b", "<s>"]), texts()) for c in [None, *range(30)] for _ in range(random.randint(1, 9))]
    rows += [(99, 0, "assistant", "ä" * 5000 + "<s>" * 2000), (99, 0, "assistant", "ä"), (99, 0, "assistant", "ä")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int")
    formatted = chat.render(chat.fold(chat.log_of(df, delta=3)))
    wanted = defaultdict(list)
    for c, t, r, x in rows:
        wanted[c].append((t is not None, t or 0, r or "", x or ""))
    out = {r["conv_id"]: r for r in formatted.collect()}
    assert set(out) == set(wanted)
    for r in chat.read_back(formatted).collect():
        turns = [x[2:] for x in sorted(wanted[r["conv_id"]])]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["loss_text"] == "".join(t for role, t in turns if role == "assistant")
        own = out[r["conv_id"]]
        # Spans by their place in the whole text say the same, and no control string stands inside one.
        spans = [own["formatted"][s["start"] : s["start"] + s["length"]] for s in own["loss"]]
        assert [re.sub(r"(?s)\\(.)", r"\1", s) for s in spans] == [t for role, t in turns if role == "assistant"]
        assert not any(c in s for s in spans for c in chat.CONTROLS)
        assert own["formatted"].count(chat.TURN) == own["n_turns"] == len(turns)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.render(chat.fold(chat.log_of(empty))).count() == 0
    assert prefix_trie.rebuilt_trie(empty).count() == 0


# --- prefix trie


def trie_by_hand(rows):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        rebuilt[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members = defaultdict(set)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * words(k[-1][1]) if k else 0
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(c for c in m if rebuilt[c] == k))).encode()).hexdigest())
        for k, m in members.items()
    )


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    random.seed(7)
    rows = []
    for c in [None, -41, -40, -3, *range(0, 70), 10**12]:
        if c == 40:
            continue
        # Ties of a turn differ in nothing or in the role, so the order is the contract's.
        for turn in [None, 0, 1, 2, 3, 4][: random.randint(1, 6)]:
            rows.append((c, turn, random.choice(["user", None]), random.choice([None, "", "hello", "two words", "hello"])))
    rows += [(60, t, "user", f"w{t} w") for t in range(10, 60)] + [(61, t, "user", f"w{t} w") for t in range(10, 60)] + rows[:9]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    rebuilt = df.where("conv_id is null or conv_id <> 80")
    found = sorted(tuple(r) for r in prefix_trie.rebuilt_trie(rebuilt.repartition(3)).collect())
    # Digest order decides between equal turns and roles; repeated rows are equal, so it does not show.
    assert found == trie_by_hand(rows)


def test_deep_and_hot_tries(spark):
    """A chain of 700 turns, and 3,000 copies of one conversation."""
    rows = [(20, t, "user", "a b") for t in range(700)] + [(c, t, "user", "same thing") for c in range(1000, 4000) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(tuple(r) for r in prefix_trie.rebuilt_trie(df).collect()) == trie_by_hand(rows)


def test_roll_up_of_a_chain(spark):
    nodes = [(d, 0, d, d - 1 if d else None, 0 if d else None, 1) for d in range(37)]
    df = spark.createDataFrame(nodes, "k1 long, k2 long, depth long, p1 long, p2 long, n long")
    found = {r["k1"]: r["n"] for r in prefix_trie.roll_up(df, ["n"], Scratch(spark, "t")).collect()}
    assert found == {d: 37 - d for d in range(37)}


# --- collocations


def count_by_hand(rows, depth):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for d in range(1, depth + 1):
                for i in range(len(w) - d + 1):
                    f[lang or "und", " ".join(w[i : i + d])] += 1
    return f, n


def collocations_by_hand(rows, depth=3, least=10, percent=50, top=2000):
    f, n = count_by_hand(rows, depth)
    cand = {k: a for k, a in f.items() if " " in k[1] and a >= least}
    out = defaultdict(list)
    for (lang, phrase), a in cand.items():
        w = phrase.split(" ")
        longer = [b for (l2, p2), b in cand.items() if l2 == lang and len(p2.split(" ")) > len(w) and f" {phrase} " in f" {p2} "]
        if any(100 * b >= percent * a for b in longer):
            continue
        cuts = []
        for k in range(1, len(w)):
            l, r = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
            cuts.append((10**6 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out[lang].append((-score, -a, phrase.encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, own in out.items() for i, (s, a, p, l, r) in enumerate(sorted(own)[:top], 1))


def some_texts():
    random.seed(8)
    vocabulary = ["The", "of", "é", "É", "in", "x\x1cy", "中文", "a", "\x00"]
    texts = ["".join(random.choice(vocabulary) + random.choice([" ", " ", "\t", "  ", ". ", "\n", "\x0b", " , "]) for _ in range(random.randint(0, 60))) for _ in range(120)]
    texts += [None, "", " \t ", "...", "lone", "x y z " * 3000, "x y z " * 3000]
    return [(random.choice(["en", "de", None]), t) for t in texts]


@pytest.mark.parametrize("depth,least,percent", [(3, 10, 50), (4, 3, 80), (2, 1, 50)])
def test_collocations_equal_brute_force(spark, depth, least, percent):
    rows = some_texts()
    df = spark.createDataFrame([(t, lang, 1, 1) for lang, t in rows], "text string, lang string, words int, n int").repartition(5)
    found = sorted(tuple(r) for r in collocations.collocations(df, depth, least, percent, top=40).collect())
    assert found == collocations_by_hand(rows, depth, least, percent, top=40)
    assert collocations.collocations(df.where("false")).count() == 0


@pytest.mark.parametrize("size,chunk", [(7, 11), (100, 50), (1 << 20, 1 << 20)])
def test_shards_cut_anywhere_count_alike(monkeypatch, size, chunk):
    """Shards of a few words and texts cut every few bytes: counts over all shards are those of whole texts."""
    monkeypatch.setattr(collocations, "SHARD", size)
    monkeypatch.setattr(collocations, "CHUNK", chunk)
    rows = [(lang or "und", t) for lang, t in some_texts()]
    batches = [pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows[i : i + 9]], "text": pa.array([r[1] for r in rows[i : i + 9]], pa.string())}) for i in range(0, len(rows), 9)]
    f, n = count_by_hand(rows, 3)
    found, totals = Counter(), Counter()
    for b in collocations.phrase_counter(None, 3)(iter(batches)):
        for r in b.to_pylist():
            (found if r["words"] else totals)[(r["lang"], r["phrase"]) if r["words"] else r["lang"]] += r["n"]
    assert found == f and +totals == +n
    hashed = Counter()
    for b in collocations.count_hashes(iter(batches)):
        for r in b.to_pylist():
            hashed[r["hash"]] += r["n"]
    assert sorted(hashed.values()) == sorted(v for k, v in f.items() if k[1].count(" ") < 2)
    # Every substring that is left in has its bit.
    bits = np.full(1 << 12, 255, np.uint8)
    assert sum(b.num_rows for b in collocations.phrase_counter(SimpleNamespace(value=bits.tobytes()), 3)(iter(batches))) >= len(f)


def test_states_of_the_automaton():
    """a b a b c: "b" alone ends where "a b" ends, so both are one state; c and its longer forms too."""
    words = [(0, b"a"), (0, b"b"), (0, b"c")]
    m = collocations.Automaton(np.array([1, 2, 1, 2, 3, 0], np.int32), 0, collocations.word_hashes(words, ["en"]), 3)
    pairs = {(int(p), int(w)): (int(c), int(k), bool(s)) for p, w, c, k, s in zip(m.prefix[2], m.last[2], m.count[2], m.link[2], m.merged(2))}
    assert pairs == {(0, 1): (2, 1, True), (1, 0): (1, 0, False), (1, 2): (1, 2, True)}
    assert m.count[3].tolist() == [1, 1, 1]
