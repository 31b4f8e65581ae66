"""Collocations, conversation repair and personal data against plain computations."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

import __spark_entry__ as contract
from medallion.llm import collocations, conversation_repair, private_data

FOLDER = "/root/testdata/sf0.001"
present = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")


def table(name):
    return duckdb.connect().execute(f"SELECT * FROM '{FOLDER}/{name}.parquet'").fetchall()


# Collocations


def plain_phrases(rows, least, top, longest=5):
    """The definition, with counters over whole lists of words."""
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, min(longest, len(words) - i) + 1):
                    counts[lang][tuple(words[i:i + k])] += 1
    found = []
    for lang, f in counts.items():
        kept, n = [], sizes[lang]
        candidates = [p for p, a in f.items() if a >= least and len(p) > 1]
        for p in candidates:
            if any(len(q) > len(p) and f[q] >= f[p]
                   and any(q[i:i + len(p)] == p for i in range(len(q))) for q in candidates):
                continue
            score, cut = min((1000 * f[p] * n // (f[p[:k]] * f[p[k:]]), k)
                             for k in range(1, len(p)))
            kept.append((-score, -f[p], " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(found)


def phrases(df, **settings):
    return sorted(tuple(r) for r in collocations.collocations(df, **settings).collect())


@pytest.mark.parametrize("budget", [1 << 20, 40])
def test_phrases_equal_the_definition(spark, monkeypatch, budget):
    """A small budget divides most prefixes, up to four words deep, into many groups."""
    pick = random.Random(5)
    vocabulary = ["a", "B", "c\x01", "c", "ü", "d\x00e", "\x01", "long-word", "b"]
    rows = []
    for _ in range(250):
        words = [pick.choice(vocabulary[:pick.randint(2, 9)]) for _ in range(pick.randint(0, 60))]
        text = "".join(w + pick.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b"])
                       for w in words)
        rows.append((pick.choice(["x", "x", None, "und"]), text))
    rows += [("x", "a b a b a b c ü " * 300), ("x", None), (None, ""), ("y", "one")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    expected = plain_phrases(rows, 20, 50)
    assert len(expected) > 60
    assert phrases(df, least=20, top=50, budget=budget) == expected
    # Texts are read in parts, and counts passed on after nearly every one.
    for name, value in (("HELD", 3), ("HELD_NUMBERS", 50), ("PART", 40), ("CODES", 4)):
        monkeypatch.setattr(collocations, name, value)
    assert phrases(df, least=20, top=50, budget=budget) == expected


@present
def test_phrases_of_the_query(spark):
    found = sorted(tuple(r) for r in contract.queries()["op11_suffix_groups"](spark, FOLDER).collect())
    rows = duckdb.connect().execute(
        f"SELECT lang, text FROM '{FOLDER}/documents.parquet'").fetchall()
    assert found == plain_phrases(rows, 100, 2000)


def test_phrases_in_corner_cases(spark):
    schema = "lang string, text string, `group` long, phrase string, n long"
    nothing = spark.createDataFrame([], schema)
    assert collocations.collocations(nothing).count() == 0
    df = spark.createDataFrame([("x", "a b " * 100, 1, "p", 2)] * 2 + [("x", None, 1, None, None)],
                               schema)
    # Only the five-word phrases and those that occur more often than any longer one remain.
    assert phrases(df) == plain_phrases([("x", "a b " * 100)] * 2, 100, 2000)
    assert phrases(df, least=1000) == []
    one = spark.createDataFrame([("x", "w" * 3_000_000), ("x", "v " * 200_000)],
                                "lang string, text string")
    assert [r[2:4] for r in phrases(one)][-1] == ("v v v v v", 199_996)


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    rows = [(10**13, 9 * 10**14, 10**13, 3 * 10**13), (7, 10**15, 7, 9), (10**12 + 1, 10**15 + 3,
             10**12 + 7, 10**12 + 9), (100, 100, 100, 100)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    found = df.select(collocations._ratio(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).collect()
    assert [r[0] for r in found] == [1000 * a * n // (x * y) for a, n, x, y in rows]


# Conversations


def plain_repair(rows):
    """Dynamic programme over prefixes of the rows with all cheapest edits kept as text.
    ``rows`` are (role, text) in order."""
    seen, marked = set(), []
    blank = duplicate = truncated = 0
    for role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        gone = cut = False
        if not core:
            blank, gone = blank + 1, True
        elif (role, text) in seen:
            duplicate, gone = duplicate + 1, True
        elif core[-1] not in ".!?":
            truncated, cut = truncated + 1, True
        seen.add((role, text))
        marked.append((role, text, gone, cut))
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    def follow(roles, initial):  # the roles so far end with: nothing, s, u, a
        if initial == "s":
            return "s" if roles == "" else None
        if initial == "u":
            return "u" if roles != "u" else None
        return "a" if initial == "a" and roles == "u" else None

    def inserted(states):
        for _ in range(4):
            for roles, (cost, audit, out) in list(states.items()):
                for initial, name in (("u", "user"), ("a", "assistant")):
                    to = follow(roles, initial)
                    if to:
                        offer = (cost + 5, audit + "I", [*out, f"{name}:"])
                        if to not in states or offer < states[to]:
                            states[to] = offer
        return states

    states = inserted({"": (0, "", [])})
    for role, text, gone, cut in marked:
        after = {}
        for roles, (cost, audit, out) in states.items():
            ways = [(roles, cost + 2, "D", out)]
            if not gone:
                more = 5 if cut else 0
                ways.append((follow(roles, role[:1]), cost + more, "K", [*out, f"{role}:{text}"]))
                for initial, name in (("u", "user"), ("a", "assistant")):
                    ways.append((follow(roles, initial), cost + 1 + more, "R",
                                 [*out, f"{name}:{text}"]))
            for to, price, edit, kept in ways:
                offer = (price, audit + edit, kept)
                if to is not None and (to not in after or offer < after[to]):
                    after[to] = offer
        states = inserted(after)
    cost, audit, out = min(states[s] for s in ("", "a") if s in states)
    return (blank, duplicate, truncated, illegal, cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        filled = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        fate = zlib.crc32(":".join(filled[:2]).encode()) % 20
        role, text = "user" if fate == 4 else filled[2], filled[3]
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def plain_conversations(original):
    by = defaultdict(list)
    for row in plain_damage(original):
        by[row[0]].append(row[1:])
    found = {}
    for conv in {r[0] for r in original}:
        rows = sorted(by[conv], key=lambda r: (
            r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        found[conv] = (gaps, *plain_repair([r[1:] for r in rows]))
    return found


def as_folder(spark, tmp_path, rows):
    schema = "conv_id long, turn long, role string, text string, place long, `key` string"
    spark.createDataFrame([(*r, 1, "k") for r in rows], schema).repartition(3).write.parquet(
        f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def repaired(spark, folder):
    return {r.conv_id: tuple(r[1:]) for r in
            contract.queries()["op12_bidirectional_repair"](spark, folder).collect()}


@present
def test_repairs_of_the_table(spark):
    assert repaired(spark, FOLDER) == plain_conversations(table("conversations"))


def test_repairs_of_odd_rows(spark, tmp_path):
    pick = random.Random(7)
    rows = []
    for conv in [*range(150), None]:
        for turn in range(pick.choice([0, 1, 1, 2, 5, 9]) + (conv is None)):
            rows.append((conv, pick.choice([turn, turn, None, 2 * turn]),
                         pick.choice(["user", "assistant", "system", "tool", "u", "", None]),
                         pick.choice(["Yes.", "No", "Why?\n", " \t", "", None, f"{turn}!", "é "])))
    rows += [(None, None, None, None), (900, 1, "user", "word " * 200_000 + ".")]
    rows += [(901, 3, "user", "Same.")] * 40
    assert repaired(spark, as_folder(spark, tmp_path, rows)) == plain_conversations(rows)


def test_repairs_of_no_rows(spark, tmp_path):
    assert repaired(spark, as_folder(spark, tmp_path, [])) == {}


def test_search_equals_dynamic_programme():
    pick = random.Random(3)
    for _ in range(3000):
        rows, seen = [], 0
        for _ in range(pick.randint(0, 9)):
            seen += 1
            text = pick.choice([f"{seen}.", f"{seen}.", f"{seen}", ""])
            rows.append((pick.choice(["user", "assistant", "system", "x"]), text))
        codes = bytes({"s": 0, "u": 1, "a": 2}.get(r[0], 3)
                      + (4 if not t else 8 if t[-1] != "." else 0) for r, t in rows)
        assert conversation_repair.cheapest(codes) == plain_repair(rows)[4:6], rows


def test_long_conversations_are_joined_from_blocks(spark):
    pick = random.Random(11)
    rows = [(c, t, pick.choice(["user", "assistant", "system", "x"]), pick.choice(
        [f"{t}.", f"{t}.", f"{t % 9}", " "])) for c, size in ((1, 700), (2, 3), (3, 90))
        for t in range(size)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    repair = conversation_repair.repair(df.repartition(5), block_bits=2)
    nothing = hashlib.sha256(b"").hexdigest()
    digests = {1: nothing, 2: nothing, 3: nothing,  # of conversations that lose all their rows
               **dict(conversation_repair.digests(repair.rows).collect())}
    for r in repair.report.collect():
        own = [x[2:] for x in rows if x[0] == r.conv_id]
        assert (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit,
                digests[r.conv_id]) == plain_repair(own)
    numbers = sorted((r.conv_id, r.number) for r in repair.rows.collect())
    assert [n for c, n in numbers if c == 1] == list(range(sum(c == 1 for c, _ in numbers)))


# Personal data

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain_spans(text):
    found = [("email", *m.span()) for m in re.finditer(EMAIL, text)]
    found += [("ip", *m.span()) for m in re.finditer(IP, text)
              if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(CARD, text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        check = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits[::-1]))
        if 13 <= len(digits) <= 19 and check % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(PHONE, text)
              if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return found


def base_spans(text):
    found = private_data.spans(text, private_data.automaton())
    return [s for s in found if s[0] in private_data.BASE]


def test_base_spans_equal_the_patterns():
    pick = random.Random(2)
    kinds = ["0123456789 -", "01.", "+1 ()-.", "a@b.c-", "a.@_ü", "+12@.ab 9-"]
    for _ in range(20_000):
        text = "".join(pick.choice(pick.choice(kinds)) for _ in range(pick.randint(0, 40)))
        assert base_spans(text) == plain_spans(text), text
    cards = ["4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009", "1" * 16, "0" * 19]
    for card in cards:
        for text in (card, f"x{card}y", f"{card} 1", f"ü {card}-", f"{card}  7"):
            assert base_spans(text) == plain_spans(text), text


@present
def test_base_spans_of_the_table(spark):
    texts = dict(duckdb.connect().execute(
        f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall())
    found = contract.queries()["op13_anchor_spans"](spark, FOLDER).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    for r in found:
        expected = plain_spans(texts[r.doc_id] or "")
        counts = Counter(k for k, _, _ in expected)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(
            counts[k] for k in ("email", "ip", "card", "phone"))
        listed = ",".join(f"{k}:{b}:{e}" for k, b, e in expected)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.spans.startswith(listed)
    assert sum(r.n_email + r.n_card for r in found) > 5


def test_spans_that_cues_and_schemes_add():
    def added(text):
        return [(k, text[b:e]) for k, b, e in private_data.spans(text, private_data.automaton())
                if k not in private_data.BASE]

    assert added('token = "6df57b16f87eabef"') == [("account", "6df57b16f87eabef")]
    assert added("Account no. 12-3456-78, paid") == [("account", "12-3456-78")]
    assert added("IBAN DE89 3704 0044 0532 0130 00 and") == [
        ("account", "DE89 3704 0044 0532 0130 00")]
    assert added("SSN: 123-45-6789.") == [("account", "123-45-6789")]
    assert added("see ftp://jo:pw@host.example.org:21/x") == [
        ("address", "jo:pw@host.example.org:21")]
    for clean in ("on account of 1234567", "the token was lost", "https://example.org/a@b",
                  "tokens = 123456", "my account: see below", "ssh://@host", "iban DE00"):
        assert added(clean) == [], clean


def test_personal_data_in_corner_cases(spark):
    schema = "doc_id long, text string, spans string, id string, _masked long"
    df = spark.createDataFrame([
        (1, "é jo@x.org, +1 (555) 555-0100", "s", "i", 1), (1, "é jo@x.org, +1 (555) 555-0100",
         "s", "i", 1), (None, None, None, None, None), (2, "", "s", "i", 1),
        (3, "1.2.3.4 " + "0" * 6000 + ".1.1.1", "s", "i", 1)], schema)
    found = [(r.id, [tuple(s) for s in r.spans]) for r in private_data.detected(df).collect()]
    both = [("email", 2, 10), ("phone", 12, 29)]
    assert found == [(1, both), (1, both), (None, []), (2, []),
                     (3, [("ip", 0, 7), ("ip", 8, 6014)])]
    masked = private_data.masked(df)
    assert masked.columns == df.columns
    assert [r.text for r in masked.collect()][:4] == ["é <email>, <phone>"] * 2 + [None, ""]
    empty = spark.createDataFrame([], schema)
    assert private_data.detected(empty).count() == private_data.masked(empty).count() == 0


def test_long_texts_take_linear_time():
    for unit in ("1 ", "1.", "+1", "a@", "@", "1  ", "a@b.", "ssh://", "account", "0", "+(", "12-"):
        base_spans(unit * 200_000)  # each would take hours if it were quadratic
