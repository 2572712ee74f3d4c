"""The corpus operators against brute force on awkward tables, and on empty ones."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliolake.llm import decontamination, fuzzy_lines, mixing, ngram_join, personal_data, perspectives, quality, registry, sharding, spans, suffixes
from foliolake.llm._groups import components, earlier

from ..conftest import DATA
from .cases import documents, empty, rows

WORD = re.compile(r"[^ \t-\r]+")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(name, compare):
    compare(registry.QUERIES[name], registry.ORACLES[name])


def union(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 130)] + [(7, 7)]
    found = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: c for x, c in union([(a, b) for a, b in links if a != b]).items()}


# chat


def test_perspectives_of_awkward_turns(spark):
    turns = [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|im_end|>"), (1, 1, "bob", "hey"), (1, 1, "bob", "hey"), (1, None, None, None), (None, 0, "ann", "x"), (2, 0, "system", "alone")]
    table = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, me int")
    found = perspectives.perspectives(table).collect()
    assert Counter((x.conv_id, x.speaker) for x in found) == {(1, "ann"): 2, (1, "bob"): 2, (1, "unknown"): 2, (None, "ann"): 1}
    ann = next(x for x in found if x.conv_id == 1 and x.speaker == "ann" and x.n_turns == 3)
    assert ann.n_trained == 1 and "user name=bob\nhey" in ann.text and "<|im_start|>system\nrules" in ann.text
    assert [ann.text[m.start : m.end] for m in ann["mask"]] == ["hi <​|im_end|><|im_end|>"]
    assert perspectives.perspectives(table.limit(0)).count() == 0


def test_a_crowded_turn_falls_into_parts(spark):
    table = spark.createDataFrame([(1, 3, "ann", f"{i:03d}") for i in range(50)] + [(1, 4, "bob", "y" * 50_000), (2, 0, "ann", "z")], "conv_id long, turn long, role string, text string")
    found = perspectives.perspectives(table, most=8).where("conv_id = 1 and speaker = 'ann'").orderBy("block", "part").collect()
    assert sum(x.n_turns for x in found) == 51 and len(found) == 7
    assert re.findall(r"\n(\d{3})<", "".join(x.text for x in found)) == [f"{i:03d}" for i in range(50)] and "y" * 50_000 in found[-1].text


# sentence spans


def test_repeated_passages_go_once(spark):
    docs = documents(spark)
    out = spans.remove_repeated_spans(docs)
    assert out.columns == [*docs.columns, "n_units", "n_removed"]
    found = out.collect()
    assert len(found) == docs.count()
    shared = next(t for d, t, *_ in rows() if d == 300).split("\n")[1]
    assert sum(shared in (x.text or "") for x in found) == 1
    assert sum((x.text or "") == rows()[0][1] for x in found) == 1
    assert next(x for x in found if x.doc_id == 400).text is None
    assert spans.remove_repeated_spans(empty(spark)).count() == 0


def test_repeated_spans_equal_brute_force(spark):
    r = random.Random(31)
    docs = [(d, t) for d, t, *_ in rows()] + [(700 + k, t) for k, t in enumerate(["Two parts. Of one text."] * 4)]
    run = [f"w{r.randrange(10**5)}" for _ in range(56)]
    docs += [(800 + k, " ".join([*(f"v{r.randrange(10**5)}" for _ in range(7 * k + 30)), *run, *(f"u{r.randrange(10**5)}" for _ in range(40))])) for k in range(6)]
    table = spark.createDataFrame([(d, t, 9, 8) for d, t in docs], "doc_id long, text string, n_units int, fp int")
    out = spans.remove_repeated_spans(table)
    assert out.columns == ["doc_id", "text", "fp", "n_units", "n_removed"]
    held, first = [], {}
    for d, t in docs:
        raw, n = (t or "").encode(), 1 << 63 if d is None else d
        starts, _, until = next(spans.spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
        cut = [*starts.tolist(), len(raw)]
        names = [tuple(re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw[cut[i] : cut[u]]).split()) for i, u in enumerate(until.tolist())]
        held.append((d, t, raw, n, cut, names, until.tolist()))
        for name in names:
            first[name] = min(n, first.get(name, n))
    want = Counter()
    for d, t, raw, n, cut, names, until in held:
        gone, seen = set(), set()
        for i, name in enumerate(names):
            if first[name] < n or name in seen:
                gone |= set(range(i, until[i]))
            seen.add(name)
        edge = [0, *cut[1:]] if len(cut) > 1 else cut
        left = raw if not gone else b"".join(raw[edge[i] : edge[i + 1]] for i in range(len(cut) - 1) if i not in gone)
        want[(d, None if t is None else left.decode(), len(cut) - 1, len(gone))] += 1
    found = out.collect()
    assert Counter((x.doc_id, x.text, x.n_units, x.n_removed) for x in found) == want
    assert all(sum(w in run for w in x.text.split()) <= 20 for x in found if 801 <= (x.doc_id or 0) < 806)
    assert [x.text for x in sorted((x for x in found if 700 <= (x.doc_id or 0) < 704), key=lambda x: x.doc_id)] == ["Two parts. Of one text.", "", "", ""]


def test_spans_follow_the_rule():
    text = b"a b c d. e f g h. i j k l. m n. o p q r s t"
    starts, keys, until = next(spans.spans(np.frombuffer(text, np.uint8), np.array([0, len(text)])))
    assert [text[a:].split()[0] for a in starts] == [b"a", b"e", b"i", b"m", b"o"] and len(keys) == 3 and until.tolist() == [3, 5, 5]  # from e on, three units have ten words only


# personal data


def test_patterns_equal_regular_expressions():
    email, ip, card, phone = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([ -]?[0-9])+", r"\+[0-9][ ().0-9-]+[0-9]"))

    def plain(text):
        out = [(m.start(), 0, m.end()) for m in email.finditer(text)]
        out += [(m.start(), 1, m.end()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        digits = lambda m: re.sub("[^0-9]", "", m[0])
        out += [(m.start(), 2, m.end()) for m in card.finditer(text) if 14 <= len(digits(m)) <= 19 and personal_data.luhn(digits(m))]
        return sorted(out + [(m.start(), 3, m.end()) for m in phone.finditer(text) if 10 <= len(digits(m)) <= 15])

    r = random.Random(4)
    pieces = ["a@b.c", "_", "@", ".", "-", " ", "+", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", "ü", "+1 (555) 123-4567", "7", "12", "(", "x.y", "@d.e-f.g", "00000001.1.1.1", "\n"]
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 12)))
        assert personal_data.base_spans(text) == plain(text), text


def test_field_beats_held_out_rows():
    field, wrong, total = personal_data.trained(), 0, 0
    for tokens, tags in personal_data.labelled_table(300, 41):
        em = field.emissions(personal_data.features(tokens, b"", b""))
        em[[not personal_data.has_digit(t) for t in tokens], 1:] = -1e4
        wrong += sum(personal_data.LABELS[k] != t for k, t in zip(field.paths([em])[0], tags))
        total += len(tags)
    assert wrong <= 0.01 * total


def test_runs_give_the_best_path_of_the_whole():
    field = personal_data.trained()
    for tokens, _ in personal_data.labelled_table(60, 8):
        text = b" ".join(tokens)
        em = field.emissions(personal_data.features(tokens, b"", b""))
        em[[not personal_data.has_digit(t) for t in tokens], 1:] = -1e9
        score, back = em[0] + field.moves[0], []
        for row in em[1:]:
            step = score[:, None] + field.moves
            back.append(step.argmax(axis=0))
            score = step.max(axis=0) + row
        path = [int((score + field.moves[:, 0]).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        begun = sum(k % 2 == 1 for k in path)
        assert len(personal_data.field_spans(field, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]) == begun


HELD_OUT = [  # written by hand: text, spans that the field has to find
    ("Please ring (212) 555-0147 before noon.", ["(212) 555-0147"]),
    ("My cell is 646-555-0199, the office 646.555.0110.", ["646-555-0199", "646.555.0110"]),
    ("SSN: 219-09-9999 is on file, order 219-09 is not.", ["219-09-9999"]),
    ("Pay to DE89 3704 0044 0532 0130 00 by Friday", ["DE89 3704 0044 0532 0130 00"]),
    ("account NL91ABNA0417164300 closed in 2019", ["NL91ABNA0417164300"]),
    ('export token = "0f3a9c2e7b1d4856aa90ce3371bd22f4" now', ["0f3a9c2e7b1d4856aa90ce3371bd22f4"]),
    ('key = "9d1f0be2c4a67788d3e5"; 4 more', ["9d1f0be2c4a67788d3e5"]),
    ("On 2024-05-17 at 10:45 we sold 1,200 of item A4-7781.", []),
    ("Version 3.12.4 costs $49.99, see page 212 of 555.", []),
    ("Server 10.20.30.40 and mail x1@mail2.example.com", []),
    ("DE89 3704 0044 0532 0130 01 has wrong check digits", []),
    ("digest 0f3a9c2e7b1d4856aa90ce3371bd22f4 of the file", []),
]


def test_field_on_sentences_written_by_hand(spark):
    table = spark.createDataFrame(list(enumerate(t for t, _ in HELD_OUT)), "doc_id long, text string")
    got, right, wanted = 0, 0, 0
    for x in personal_data.find_personal_data(table).collect():
        text, want = HELD_OUT[x.doc_id]
        found = [text[int(a) : int(b)] for k, a, b in (s.split(":") for s in x.spans.split(",") if s) if k in personal_data.FOUND]
        got, right, wanted = got + len(found), right + len(set(found) & set(want)), wanted + len(want)
    assert right >= 0.9 * got and right >= 0.85 * wanted, (got, right, wanted)


def test_planted_secrets_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = {(x.doc_id, m[1]) for x in docs.collect() for m in re.finditer(r'token = "([0-9a-f]+)"', x.text or "")}
    texts = {x.doc_id: x.text for x in docs.collect()}
    found = set()
    for x in personal_data.find_personal_data(docs).collect():
        found |= {(x.doc_id, texts[x.doc_id][int(a) : int(b)]) for k, a, b in (s.split(":") for s in x.spans.split(",") if s) if k in personal_data.FOUND}
    assert len(want) >= 10 and len(found & want) >= 0.9 * len(want) and len(found & want) >= 0.9 * len(found), (len(found), len(want), len(found & want))


def test_personal_data_of_awkward_texts(spark):
    long = "q" * 200_000 + " SSN 078-05-1120"
    rows = [(1, "ü a@b.co, SSN 078-05-1120 and 1.2.3.4", 0), (2, None, 0), (None, "", 0), (3, long, 0), (3, long, 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, base int")
    every = personal_data.find_personal_data(table).collect()
    found = {x.doc_id: x for x in every}
    assert found[1].base == "email:2:8,ip:30:37" and found[1].spans == "email:2:8,ssn:14:25,ip:30:37"
    assert found[2].spans == "" and found[None].n_email == 0 and len(every) == 5 and found[3].spans == "ssn:200005:200016"
    broken = spark.sql("SELECT 9L AS doc_id, cast(unhex('61FF20612E62403C20612E6240632E64') AS string) AS text")
    assert personal_data.find_personal_data(broken).first().n_email == 1
    assert personal_data.find_personal_data(table.limit(0)).count() == 0


# mixing


def test_mix_meets_targets(spark):
    docs = documents(spark)
    found = mixing.taken_words(docs, block_words=64).collect()
    assert len(found) == docs.count()
    by = defaultdict(lambda: [0, 0.0, 0])
    for x in found:
        assert 0 <= x.taken <= 3 * x.size
        by[x.source][0] += x.taken
        by[x.source][1] = x.target
        by[x.source][2] += x.size
    assert all(abs(t - want) <= 0.5 and want <= 3 * size for t, want, size in by.values())
    assert abs(sum(w for _, w, _ in by.values()) - sum(s for *_, s in by.values())) < 1e-6
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mixing.taken_words(docs, block_words=64).collect()), key=str)
    assert mixing.taken_words(empty(spark)).count() == 0


def test_schedule_spreads_each_source(spark):
    sizes = spark.createDataFrame([(i, s, 100) for i, s in enumerate(["a"] * 40 + ["b"] * 40 + ["c"] * 40)], "doc_id long, source string, size long")
    plan = mixing.source_plan(sizes, block_words=10)
    slots = sorted((x.slot, x.idx, x["rank"]) for x in mixing.schedule(plan).collect())
    share = {x.idx: x.slots for x in plan.collect()}
    assert Counter(i for _, i, _ in slots) == share
    seen, total = Counter(), sum(share.values())
    for k, (_, i, rank) in enumerate(slots, 1):
        assert rank == seen[i]
        seen[i] += 1
        assert all(abs(seen[j] - k * n / total) <= 12 for j, n in share.items())


# sharding


def test_shards_fit_and_keep_all(spark):
    docs = documents(spark)
    found = sharding.assign(docs, 4000).collect()
    assert len(found) == docs.count() and set(docs.columns) < set(found[0].asDict())
    held = defaultdict(list)
    for x in found:
        held[x.shard].append(x)
    for own in held.values():
        size = sum(x.n_bytes for x in own)
        assert size == own[0].shard_bytes and (size <= 4000 or len({(x.doc_id, x.text) for x in own}) == 1)
    names = list(held)
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    assert sharding.assign(empty(spark)).count() == 0


def test_one_id_in_many_rows_splits_by_text(spark):
    table = spark.createDataFrame([(7, f"text {i} " * 10) for i in range(60)], "doc_id long, text string")
    found = sharding.assign(table, 1000).collect()
    assert len(found) == 60 and max(x.shard_bytes for x in found) <= 1000


# decontamination


def test_leaks_and_paraphrases(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9)))
    items = [(i, " ".join(word() for _ in range(r.randint(12, 60))) + ".") for i in range(40)] + [(98, None), (99, "too short")]
    docs, want = [], set()
    for i in range(200):
        tokens = [word() for _ in range(r.randint(20, 200))]
        if i % 4 == 0:
            k = r.randrange(40)
            own = items[k][1].split()
            if i % 8 == 0:
                own = [w if j % 9 else word() for j, w in enumerate(own)]
            at = r.randrange(len(tokens))
            tokens[at:at] = own
            want.add((i, k))
        docs.append((i, " ".join(tokens), 0))
    docs += [(None, items[0][1], 0), (500, None, 0), (501, "", 0), (502, "so it was TOO short here", 0), (502, "too late and short", 0), (503, items[0][1] + " " + "x " * 30_000, 0), (503, items[0][1] + " " + "x " * 30_000, 0)]
    want |= {(None, 0), (502, 99), (503, 0)}
    table = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    found = {(x.doc_id, x.item_id) for x in decontamination.leaks(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found <= want and len(found) >= 0.9 * len(want) and {(None, 0), (502, 99), (503, 0)} <= found
    some = spark.createDataFrame([(None, 1, 5, 80), (None, 2, 5, 90), (None, 2, 6, 50), (7, 1, 5, 60), (7, 2, 5, 70)], "doc_id long, fp long, item_id long, lcs_percent long")
    assert sorted(map(tuple, decontamination.by_document(some).collect()), key=str) == sorted([(None, 5, 80), (None, 5, 90), (None, 6, 50), (7, 5, 70)], key=str)
    assert decontamination.leaks(table.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontamination.leaks(table, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_frequent_items_are_found(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 9)))
    items = [(k, " ".join(word() for _ in range(37))) for k in range(3)]
    docs = []
    for i in range(90):
        tokens = [word() for _ in range(40)]
        if i % 3 == 0:
            at = r.randrange(40)
            tokens[at:at] = items[1][1].split()
        docs.append((i, " ".join(tokens)))
    schema = "doc_id long, text string"
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(x.doc_id, x.item_id, x.lcs_percent) for x in decontamination.leaks(spark.createDataFrame(docs, schema), benchmark).collect()}
    assert found == {(i, 1, 100) for i in range(0, 90, 3)}
    names = ["doc_id", "item_id", "lcs_percent"]
    small = spark.createDataFrame([(1, "before " + items[0][1] + " after"), (2, "nothing of it")], schema)
    assert [tuple(x) for x in decontamination.leaks(small, benchmark).select(*names).collect()] == [(1, 0, 100)]


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([bytes([97 + r.randrange(4)]) for _ in range(r.randint(0, 12))] for _ in range(2))
        grid = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                grid[i + 1][j + 1] = grid[i][j] + 1 if x == y else max(grid[i][j + 1], grid[i + 1][j])
        assert decontamination.common_subsequence(a, b) == grid[-1][-1]


def test_only_oversized_buckets_split(spark):
    """Against the rule itself; the input's own columns of the names that are added are replaced."""
    docs = [(i, "x" * (900 if i % 50 == 0 else 20 + i % 7), "mine", -1, "k") for i in range(1500)]
    table = spark.createDataFrame(docs, "doc_id long, text string, shard string, depth int, key long".replace("key long", "key string"))
    found = sharding.assign(table, 3000)
    assert found.columns == ["doc_id", "text", "key", "shard", "depth", "n_bytes", "shard_bytes", "shard_docs", "over_limit"]
    bits = {i: format(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), "060b") for i, *_ in docs}
    sizes = Counter()
    for i, t, *_ in docs:
        for d in range(30):
            sizes[bits[i][:d]] += len(t)
    for x in found.collect():
        prefix = "" if x.shard == "*" else x.shard
        assert len(prefix) == x.depth and bits[x.doc_id].startswith(prefix) and sizes[prefix] == x.shard_bytes <= 3000
        assert x.depth == 0 or sizes[prefix[:-1]] > 3000


# fuzzy lines


def brute_fuzzy(docs):
    """Per distinct line its component under the exact rule: (lines by first place, union of links)."""
    norm = lambda t: t.lower().strip(" \t\r\v\f")
    grams = lambda t: frozenset(t[i : i + 5] for i in range(max(1, len(t) - 4)))
    first = {}
    for d, t in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        for line in (t or "").split("\n"):
            if norm(line):
                first.setdefault(norm(line), d)
    by_gram, sets = defaultdict(set), {t: grams(t) for t in first}
    links = set()
    for t, s in sets.items():
        counted = Counter(o for g in s for o in by_gram[g])
        links |= {(t, o) for o, c in counted.items() if 100 * c >= 80 * (len(s) + len(sets[o]) - c)}
        for g in s:
            by_gram[g].add(t)
    return first, links


def test_fuzzy_lines_keep_one_each(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcdefgh    ") for _ in range(90)) for _ in range(12)]
    docs = []
    for i in range(60):
        own = [base[(i + k) % 12] for k in range(3)]
        own = [t[: 10 + k] + "z" + t[11 + k :] if (i + k) % 3 else t for k, t in enumerate(own)]
        docs.append((i, "\n".join([*own, "short", "", "  "]), 1, 5))
    docs += [(None, base[0], 1, 5), (None, base[1] + "\n" + base[0], 1, 5), (100, None, 1, 5), (101, "", 1, 5), (102, base[0] + "\n" + base[0], 1, 5), (103, "only here", 1, 5), (103, "only here", 1, 5), (104, "w" * 30_000, 1, 5)]
    table = spark.createDataFrame(docs, "doc_id long, text string, line int, n_lines int")
    out = fuzzy_lines.remove_fuzzy_lines(table)
    assert out.columns == ["doc_id", "text", "line", "n_lines", "n_removed"]
    found = out.collect()
    left = [t.strip().lower() for x in found for t in (x.text or "").split("\n") if t.strip()]
    grams = lambda t: {t[i : i + 5] for i in range(len(t) - 4)}
    similar = lambda a, b: a != b and 100 * len(grams(a) & grams(b)) >= 80 * len(grams(a) | grams(b))
    assert Counter(left) == Counter({t: 1 + (t == "only here") for t in left}) and len(set(left)) == 15
    assert not any(similar(a, b) for i, a in enumerate(left) for b in left[:i])
    assert next(x for x in found if x.doc_id == 100).text is None and len(found) == len(docs)
    assert next(x for x in found if x.doc_id == 5).n_lines == 6 and sum((x.text or "").split("\n").count("") for x in found) >= 60
    assert fuzzy_lines.remove_fuzzy_lines(table.limit(0)).count() == 0


def test_links_of_lines_against_brute_force(spark):
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    first, links = brute_fuzzy([tuple(x) for x in docs.collect()])
    r = random.Random(15)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9)))
    short = []
    for _ in range(400):  # lines of a few words with one dropped, where bands are few
        own = [word() for _ in range(r.randint(5, 12))]
        k = r.randrange(len(own))
        short += [" ".join(own), " ".join(own[:k] + own[k + 1 :])]
    more, near = brute_fuzzy([(10**6 + i, t) for i, t in enumerate(short)])
    table = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(short)], "doc_id long, text string"))
    names = {x.line: x.h for x in spark.createDataFrame([(t,) for t in [*first, *more]], "line string").select("line", F.xxhash64("line").alias("h")).collect()}
    *_, parts = fuzzy_lines.fuzzy_links(table)
    place = {x.node: x.component for x in parts.collect()}
    for every in (links, near):
        caught = sum(place.get(names[a], 0) == place.get(names[b], 1) for a, b in every)
        assert len(every) > 100 and caught >= 0.95 * len(every), (caught, len(every))
    apart = union([(names[a], names[b]) for a, b in links | near])
    assert all(apart.get(n) is not None for n in place) and len({(c, apart[n]) for n, c in place.items()}) == len(set(place.values()))


def test_links_of_lines_of_few_long_words(spark):
    """Addresses, digests and compound words: one character changed, left out or put in."""
    r = random.Random(16)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789_"
    pairs = {}
    for n, size in ((1, 60), (2, 30), (3, 20), (1, 40), (4, 15), (1, 120)):
        lines = []
        for _ in range(900 if size == 40 else 300):
            line = " ".join("".join(r.choice(letters) for _ in range(size)) for _ in range(n))
            k, kind = r.randrange(1, len(line) - 1), r.randrange(3)
            lines += [line, line[:k] + ("" if kind == 0 else "!" if kind == 1 else "q" + line[k]) + line[k + 1 :]]
        pairs[n, size] = brute_fuzzy(list(enumerate(lines)))[1]
        assert len(pairs[n, size]) >= 100, (n, size)
    every = sorted({t for links in pairs.values() for link in links for t in link})
    table = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    names = {x.text: x.h for x in table.select("text", F.xxhash64("text").alias("h")).collect()}
    *_, parts = fuzzy_lines.fuzzy_links(table)
    place = {x.node: x.component for x in parts.collect()}
    for size, links in pairs.items():
        caught = sum(place.get(names[a], 0) == place.get(names[b], 1) for a, b in links)
        assert caught >= 0.95 * len(links), (size, caught, len(links))


# quality


def plain_counts(text):
    own = WORD.findall(text or "")
    lines, seen, dups = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    windows = defaultdict(list)
    for i in range(len(own) - 7):
        windows[tuple(own[i : i + 8])].append(i)
    covered = {i + k for v in windows.values() if len(v) > 1 for i in v for k in range(8)}
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(covered)


def test_quality_counts_and_verdicts(spark):
    r = random.Random(6)
    clean = [(1000 + i, " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(r.randrange(10**6)) for _ in range(r.randint(30, 90))), "xx", "s", None, 0, 0, "") for i in range(300)]
    junk = [(2000 + i, "### $$$ ||| %% &&& <<>> *** " * 2 + " ".join(f"#{r.randrange(10**9)}$" for _ in range(40)), "xx", "s", None, 0, 0, "") for i in range(10)]
    table = documents(spark).unionByName(spark.createDataFrame(clean + junk, documents(spark).schema))
    found = quality.judge(table).collect()
    assert len(found) == table.count()
    want = Counter((d, *plain_counts(t)) for d, t, *_ in [*rows(), *clean, *junk])
    assert Counter((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in found) == want
    assert all(x.base_failed == (x.n_words < 20 or 100 * x.n_repeat_words > 30 * x.n_words) for x in found)
    assert all(x.kept for x in found if (x.doc_id or 0) // 1000 == 1) and not any(x.kept for x in found if (x.doc_id or 0) // 1000 == 2)
    assert quality.judge(empty(spark)).count() == 0


# n-gram join


def shingles(text):
    own = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return frozenset(tuple(own[i : i + 4]) for i in range(max(1, len(own) - 3))) if own else frozenset()


def brute_components(docs):
    sets = [(d, shingles(t)) for d, t in docs if d is not None]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= 85 * len(x | y)]
    return union(links)


def near_copies(n, seed=8):
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(i % 9):
            own[r.randrange(150)] = f"x{r.randrange(10**9)}"
        out.append((i + 1000, " ".join(own)))
    return out


@pytest.mark.parametrize("often", [32, -40])
def test_join_equals_brute_force(spark, often, monkeypatch):
    monkeypatch.setattr(ngram_join, "MORE", often)
    monkeypatch.setattr(ngram_join, "TIMES", 4 if often > 0 else 0)
    docs = [(d, t) for d, t, *_ in rows()] + near_copies(60)
    table = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, n int")
    found = ngram_join.linked(table).collect()
    want = brute_components(docs)
    assert Counter((x.doc_id, x.n_shingles) for x in found) == Counter((d, len(shingles(t))) for d, t in docs)
    assert all(x.component_id == want.get(x.doc_id, x.doc_id) for x in found)
    assert ngram_join.linked(table.limit(0)).count() == 0


# suffixes


def test_suffixes_equal_brute_force(spark):
    docs = [((1 << 63) - 1 if d is None else d, (t or "").encode()) for d, t, *_ in rows()] + [(600, b"aab" * 40), (601, b"aab" * 60), (602, b"a" * 49)]
    first: dict[bytes, int] = {}
    for d, t in docs:
        for i in range(len(t) - 49):
            w = t[i : i + 50]
            first[w] = min(d, first.get(w, d))
    want = Counter()
    for d, t in docs:
        gone = bytearray(len(t))
        for i in range(len(t) - 49):
            if first[t[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(t, gone) if not g)
        want[(None if d == (1 << 63) - 1 else d, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())] += 1
    table = spark.createDataFrame([(None if d == (1 << 63) - 1 else d, t.decode(), 0) for d, t in docs], "doc_id long, text string, key int")
    out = suffixes.remove_later_copies(table).withColumn("sha", F.sha2("kept", 256))
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.sha) for x in out.collect()) == want
    assert suffixes.remove_later_copies(empty(spark)).count() == 0


def test_previous_factors_equal_their_definition():
    r = random.Random(11)
    for _ in range(200):
        texts = [bytes(r.choice(b"ab") for _ in range(r.randint(6, 30))) for _ in range(r.randint(1, 6))]
        every = sorted((t[i : i + 6], d) for d, t in enumerate(texts) for i in range(len(t) - 5))
        shared = lambda a, b: next((k for k in range(6) if a[k] != b[k]), 6)
        common = np.array([0] + [shared(a, b) for (a, _), (b, _) in zip(every, every[1:])])
        found = suffixes.previous_factors(common, np.array([d for _, d in every]), 6)
        want = [max([shared(t, o) for o, e in every if e < d], default=0) for t, d in every]
        assert [x >= 6 for x in found] == [x >= 6 for x in want] and all(x <= y for x, y in zip(found, want))


def test_windows_that_no_other_equals_are_not_sorted(monkeypatch):
    r, previous = random.Random(14), suffixes.previous_factors
    for _ in range(50):
        stretches = [(1, d, bytes(r.choice(b"abc") for _ in range(r.randint(6, 40)))) for d in range(r.randint(1, 8))]
        sorted_rows = []
        monkeypatch.setattr(suffixes, "previous_factors", lambda common, doc, length, own=previous: (sorted_rows.append(len(doc)), own(common, doc, length))[1])
        found, begin = suffixes.repeated_windows(stretches, 6)
        every = [(t[i : i + 6], d) for _, d, t in stretches for i in range(len(t) - 5)]
        times = Counter(w for w, _ in every)
        assert found.tolist() == [any(o == w and e < d for o, e in every) for w, d in every]
        assert begin.tolist() == [sum(len(t) - 5 for _, _, t in stretches[:k]) for k in range(len(stretches))]
        # words that share a cell of the table by chance may be sorted too
        assert sum(n for n in times.values() if n > 1) <= sorted_rows[0] <= sum(n for n in times.values() if n > 1) + 4


def test_one_anchor_in_thousands_of_documents(spark):
    head = b"The same header line stands at the top of every page of this place, always. "
    docs = [(i, head + b"%d own words follow here, number %d of them." % (i * 7919, i)) for i in range(5000)]
    table = spark.createDataFrame([(d, t.decode()) for d, t in docs], "doc_id long, text string")
    found = {x.doc_id: x for x in suffixes.remove_later_copies(table).collect()}
    assert found[0].n_removed == 0 and all(found[d].n_removed >= len(head) and found[d].n_spans >= 1 for d, _ in docs[1:])


def test_long_stretches_of_one_byte():
    data = np.frombuffer(b"x" * 500, np.uint8)
    keys, first, last, row = suffixes.stretches(data, np.array([0, 500]))
    assert (first.tolist(), last.tolist(), row.tolist()) == ([0], [450], [0])


def test_candidates_of_fuzzy_lines_travel_as_text(spark, monkeypatch):
    """Staged tables take a few bytes a character of near-equal long lines, not eight for each shingle."""
    from pathlib import Path

    from foliolake.llm import fuzzy_lines

    r = random.Random(8)
    rows, size = [], 0
    for k in range(60):
        words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(3, 9))) for _ in range(1500)]
        for j in range(4):
            own = list(words)
            own[100 * j + 7] = "changed"
            rows.append((4 * k + j, " ".join(own)))
            size += len(rows[-1][1])
    written, stage = [], fuzzy_lines.stage

    def counted(df, name):
        out = stage(df, name)
        written.append((sum(f.stat().st_size for f in Path(out._staged_at.removeprefix("file:")).rglob("*.parquet")), name))
        return out

    monkeypatch.setattr(fuzzy_lines, "stage", counted)
    found = fuzzy_lines.remove_fuzzy_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id for x in found.where("n_removed = 0").collect()} == set(range(0, 240, 4))
    assert max(written)[0] < 2 * size, max(written)


def test_a_pair_of_many_groups_is_made_in_few(spark):
    """Of near copies that share most of 200 keys every pair is made, about once, not once a key."""
    r = random.Random(4)
    own = {doc: set(r.sample(range(200), 190)) | {1000 + doc} for doc in range(12)} | {doc: {r.randrange(200), 2000 + doc} for doc in range(12, 30)}
    rows = earlier(spark.createDataFrame([(key, doc, 0) for doc, keys in own.items() for key in keys], "key long, doc long, fact long"))
    one, other = (rows.select("key", F.col("doc").alias(f"doc{i}"), F.col("before").alias(f"before{i}")) for i in (1, 2))
    made = one.join(other, "key").where((F.col("doc1") < F.col("doc2")) & ~F.arrays_overlap("before1", "before2")).select("doc1", "doc2").collect()
    wanted = {(a, b) for a in own for b in own if a < b and own[a] & own[b]}
    assert {tuple(x) for x in made} == wanted and len(made) <= 1.2 * len(wanted)
