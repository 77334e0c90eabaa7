"""The ten operators on small fixtures: brute force, round trips, and defined edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import arc_convert, chat_format, decontaminate, line_dedup, lm_scoring, near_dedup, ordinal_quality, quality_rules, source_mixing, token_counts
from foliant.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, word int"
TABLES = {
    "documents": DOCS,
    "labels": "doc_id long, quality int, toxic int, text string",
    "benchmark": "item_id long, text string, doc_id long",
    "pages": "page_id long, url string, html string, digest int",
    "conversations": "conv_id long, turn long, role string, text string, tree int",
}


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("bdklmnrst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))


def doc(i, text, source="a"):
    return (i, text, "en", source, len(text or ""), "x", 1)


def edge_docs():
    base = prose(1, 300)
    words = base.split()
    near = [" ".join(w if k != 20 + 7 * j else f"other{j}" for k, w in enumerate(words)) for j in range(6)]
    out = [doc(0, None), doc(1, ""), doc(2, " \n\t "), doc(3, "one"), doc(4, "One"), doc(5, "a b"), doc(6, base), doc(7, base.upper()), doc(8, base + "\n" + base), doc(8, prose(3, 60)), doc(None, prose(4, 60), None)]
    out += [doc(10 + j, t, "b") for j, t in enumerate(near)] + [doc(20, prose(5, 30_000), "é"), doc(6, base)]
    item = prose(77, 30)
    out += [doc(30, prose(6, 80) + " " + item + " " + prose(7, 80)), doc(31, prose(8, 40) + "\n" + prose(9, 40) + "\n" + prose(8, 40))]
    out += [doc(40 + j, prose(100 + j, 80) + " idiot" * (j % 2) + "\n" + " ".join(f"x{k}%%% " for k in range(80 * (j % 3 == 0))), "cd"[j % 2]) for j in range(60)]
    return out


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("edge"))
    data = {
        "documents": edge_docs(),
        "labels": [(40 + j, int(j % 3 != 0), j % 2, "t") for j in range(60)] + [(None, 1, 0, "t"), (41, None, None, "t"), (999, 0, 0, "t")],
        "benchmark": [(1, prose(77, 30), 5), (2, None, 5), (None, "x y", 5), (3, "", 5), (1, prose(77, 30), 5)],
        "pages": [(1, "http://a b/", "<p>" + "x" * 200, 0), (2, None, "<p>" + "x" * 200, 0), (3, "http://c/", None, 0), (4, "u", "short", 0), (5, "u", "short", 0), (None, "v", "<p>" + "x" * 200, 0), (6, "w", "a\r\n\r\nb\n" * 40, 0), (7, "w", "é" * 100, 0)],
        "conversations": [(1, 0, "user", None, 0), (1, 1, "assistant", "a\\l<s>[x]</s>\\", 0), (1, 1, "assistant", "a", 0), (2, 5, None, "é😀", 0), (2, None, "system", "", 0), (None, 0, "assistant", "[/INST]", 0), (3, 0, "assistant", "\\e\\", 0)],
    }
    for name, schema in TABLES.items():
        spark.createDataFrame(data[name], schema).coalesce(2).write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(f"{d}/{name}.parquet")
    return d


OPS = {
    "op1": arc_convert.op1_arc_to_warc, "op2": chat_format.op2_chat_formatting, "op3": decontaminate.op3_benchmark_decontamination, "op4": line_dedup.op4_line_dedup,
    "op5": ordinal_quality.op5_ordinal_quality, "op6": source_mixing.op6_source_mixing, "op7": lm_scoring.op7_lm_scoring, "op8": near_dedup.op8_minhash_near_dedup,
    "op9": token_counts.op9_token_counts, "op10": quality_rules.op10_quality_rules,
}


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(spark, empty, name):
    assert OPS[name](spark, empty).count() == (1 if name == "op2" else 0)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_empty_documents(spark, empty, edge, k):
    docs = spark.read.parquet(f"{empty}/documents.parquet")
    out = corpus_pipeline.STAGES[k][1](spark, docs, edge)
    assert out.count() == 0 and (k == 4 or out.columns == docs.columns)


def test_arc_and_warc(spark, edge):
    got = {r["page_id"]: r for r in OPS["op1"](spark, edge).collect()}
    x = "<p>" + "x" * 200
    assert len(got) == 8 and got[1]["record_type"] == "response" and got[None]["record_type"] == "response"
    assert (got[2]["record_type"], got[2]["refers_to"], got[2]["payload_bytes"], got[2]["payload_digest"]) == ("revisit", 1, 203, hashlib.sha256(x.encode()).hexdigest())
    assert got[5]["record_type"] == "response" and got[3]["payload_bytes"] == 0 and got[6]["payload_bytes"] == 280 and got[7]["payload_bytes"] == 200


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    rows = [("http://a/", "20010203040506", b"HTTP/1.0 200 OK\r\n\r\n\n\nx"), ("u", "19990101000000", b"")]
    back = list(arc_convert.read_arc(arc_convert.write_arc(rows, version)))
    assert [(r["URL"], r["Archive-date"], r["block"], r["version"]) for r in back] == [(*r, version) for r in rows]


def test_conversations_come_back(spark, edge):
    got = {r["conv_id"]: r for r in OPS["op2"](spark, edge).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, None, -7}
    assert got[1]["loss_sha256"] == sha("a" + "a\\l<s>[x]</s>\\") and got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 15
    assert got[3]["turns_sha256"] == sha("assistant\n\\e\\\n") and got[None]["loss_sha256"] == sha("[/INST]") and got[2]["loss_chars"] == 0
    assert got[-7]["loss_sha256"] == sha("</s>[INST] ok [/INST]")


def test_mask_spans_are_the_assistant_texts(spark, edge):
    rows = spark.read.parquet(f"{edge}/conversations.parquet").select("conv_id", "turn", "role", "text")
    codes = {code: plain for plain, code in chat_format.ESCAPES}
    plain = lambda t: re.sub(r"\\[elbr]", lambda m: codes[m[0]], t)
    got = {r["conv_id"]: [plain(r["formatted"][s["start"] : s["end"]]) if s else None for s in r["spans"]] for r in chat_format.format_conversations(spark, rows).collect()}
    assert got == {1: [None, "a", "a\\l<s>[x]</s>\\"], 2: [None, None], 3: ["\\e\\"], None: ["[/INST]"]}


def test_reply_tree_branches(spark):
    m = spark.createDataFrame([("t", "r", None, 0.0), ("t", "a", "r", 1.0), ("t", "b", "r", 3.0), ("t", "c", "a", 5.0), ("t", "d", "x", 1.0)], "tree string, node string, parent string, score double")
    one = chat_format.tree_paths(m, 1, Scratch(spark, "t")).collect()
    assert sorted((r["place"], r["node"]) for r in one) == [(1, "r"), (2, "a"), (3, "c")]
    every = chat_format.tree_paths(m, None, Scratch(spark, "t")).collect()
    assert sorted(collections.Counter(r["leaf"] for r in every).items()) == [("b", 2), ("c", 3), ("d", 1)]


def test_decontamination(spark, edge):
    assert [(r["doc_id"], r["item_id"]) for r in OPS["op3"](spark, edge).collect()] == [(30, 1)]


def test_item_in_a_third_of_the_documents_is_found(spark):
    items = [(k, prose(5000 + k, 30)) for k in range(100)]
    edited = " ".join(w if k % 6 else "changed" for k, w in enumerate(items[0][1].split()))
    inside = lambda i: (items[0][1] if i % 2 else edited) if i % 3 == 0 else items[i // 3][1] if i < 60 else ""
    docs = spark.createDataFrame([(i, f"{prose(6000 + i, 30)} {inside(i)} {prose(9000 + i, 30)}") for i in range(1500)], "doc_id long, text string")
    found = decontaminate.leaks(spark, docs.repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(i, 0) for i in range(0, 1500, 3)} | {(i, i // 3) for i in range(60) if i % 3}
    assert {(r["doc_id"], r["item_id"]) for r in found} == want


def test_long_items_are_found(spark):
    items = [(k, prose(7000 + k, n)) for k, n in enumerate((30, 72, 73, 300, 600, 7000))]
    docs = [(10 * k + j, f"{prose(8000 + j, 20 + 9 * j)} {t} {prose(8100 + j, 50)}") for k, t in items for j in range(3)]
    docs += [(900 + j, prose(8200 + j, 700)) for j in range(20)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    found = decontaminate.leaks(spark, docs.repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(10 * k + j, k) for k in range(6) for j in range(3)}
    assert all(decontaminate.cuts(n)[-1][1] == n and all(b - a <= 72 for a, b in decontaminate.cuts(n)) for n in range(1, 300))


def test_lcs_equals_dynamic_programme():
    r = random.Random(2)
    for _ in range(100):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(a, decontaminate.positions(b)) == t[-1][-1]


def test_line_dedup_against_brute_force(spark):
    r = random.Random(3)
    lines = [prose(200 + k, 12) for k in range(30)]
    near = [ln.replace(ln.split()[3], "zzz", 1) for ln in lines[:12]]
    pool = lines + near + ["", " ", "ab", "ab"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(6))) for i in range(40)] + [(50, None), (51, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone, *_ = line_dedup.dropped_lines(spark, docs)
    got = {x["ord"]: x["dropped"] for x in gone.collect()}
    distinct = sorted({ln for _, t in rows if t for ln in t.split("\n") if WORD.search(ln)})
    sets = {ln: {ln[k : k + 8] for k in range(len(ln) - 7)} for ln in distinct}
    parent = {ln: ln for ln in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(x)] = root(y)
    first, want = {}, {}
    for i, t in rows:
        for k, ln in enumerate((t or "").split("\n")):
            if WORD.search(ln) and first.setdefault(root(ln), (i, k)) != (i, k):
                want.setdefault(i, []).append(k)
    assert got == want


def test_repeated_units_against_brute_force(spark):
    click, rule = "click here to buy ", "+----"
    lines = [click * k for k in (5, 8, 9, 30, 200)] + ["-" * k for k in (8, 10, 90, 150, 1000)] + [rule * k for k in (2, 3, 40, 400)]
    lines += ["=" * 7, "=" * 8, prose(500, 300), prose(500, 300) + " " + prose(501, 4), prose(502, 300), "abcdefgh", "abcdefghi", "abcdefghij"]
    sets = [{x[k : k + 8] for k in range(len(x) - 7)} for x in lines]
    group = list(range(len(lines)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    want = [i for i in range(len(lines)) if group.index(group[i]) != i]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone, *_ = line_dedup.dropped_lines(spark, docs)
    assert sorted(x["ord"] for x in gone.collect()) == want and len(want) == 11


def test_ordinal_quality_finds_toxic_words(spark, tmp_path):
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        rows.append(doc(i, prose(1000 + i, 60) + (" scum moron" if bad else " fine kind")))
        labels.append((i, 1, int(bad), "t"))
    docs = spark.createDataFrame(rows, DOCS)
    model = ordinal_quality.train(spark, docs.where("doc_id < 400"), spark.createDataFrame(labels, TABLES["labels"]))
    held = {r["doc_id"]: r["kept"] for r in ordinal_quality.score(spark, docs.where("doc_id >= 400"), model).collect()}
    assert sum(held[i] == (i % 4 != 0) for i in held) >= 0.95 * len(held)


def test_mixing(spark, edge):
    rows = OPS["op6"](spark, edge).collect()
    again = OPS["op6"](spark, edge).collect()
    key = lambda r: (str(r["source"]), -1 if r["doc_id"] is None else r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again)) and all(r["taken"] <= 2 * r["size"] for r in rows)
    size, target, took = collections.Counter(), {}, collections.Counter()
    for r in rows:
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        took[r["source"]] += r["taken"]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted((s for s in size if s), key=lambda s: [ord(c) for c in s]) + [None] * (None in size))}
    budget, full = 1.5 * sum(size.values()), set()
    while True:
        level = (budget - sum(2 * size[s] for s in full)) / max(sum(weights[s] for s in size if s not in full), 1e-9)
        more = {s for s in size if s not in full and weights[s] * level > 2 * size[s]}
        if not more:
            break
        full |= more
    for s in size:
        want = 2 * size[s] if s in full else weights[s] * level
        assert math.isclose(target[s], want, rel_tol=1e-9) and abs(took[s] - want) <= source_mixing.BLOCK


def test_mix_holds_the_words_of_its_blocks(spark, edge):
    place, slots, _ = source_mixing.mix(spark, spark.read.parquet(f"{edge}/documents.parquet"))
    places = place("text")
    out = source_mixing.dealt(places, slots).collect()
    docs = [r for r in places.collect() if r["size"]]
    stream = collections.defaultdict(list)
    for r in sorted(docs, key=lambda r: r["start"]):
        stream[r["sid"]] += WORD.findall(r["text"])
    n = source_mixing.BLOCK
    assert all(r["words"] == " ".join(stream[r["sid"]][r["block"] * n : (r["block"] + 1) * n]) for r in out) and len(out) == slots.count() > 0
    at = collections.defaultdict(list)
    for r in out:
        at[r["shard"]].append(r["position"])
    assert all(sorted(x) == list(range(len(x))) for x in at.values())
    took = collections.Counter()
    for r in out:
        assert sum(p["n"] for p in r["pieces"]) == len(r["words"].split(" "))
        for p in r["pieces"]:
            took[r["sid"], p["chunk"], p["rn"]] += p["n"]
    got = source_mixing.taken(places, source_mixing.dealt(places, slots)).where("size > 0").collect()
    assert {(r["sid"], r["chunk"], r["rn"]): r["taken"] for r in got} == {(r["sid"], r["chunk"], r["rn"]): took[r["sid"], r["chunk"], r["rn"]] for r in docs}


def test_permutation(spark):
    for n in (1, 2, 7, 100):
        d = spark.range(n).selectExpr(f"{source_mixing.permuted('id', f'{n}L', '3L', '0L')} as p")
        assert sorted(r["p"] for r in d.collect()) == list(range(n))


def test_lm_scoring_base(spark, edge):
    rows = OPS["op7"](spark, edge).collect()
    tokens = lambda t: [*WORD.findall((t or "").translate(LOW)), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    docs = edge_docs()
    counts = collections.Counter(w for d in docs if not held(d[0]) for w in tokens(d[1]))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d[0]), held(d[0]), len(tokens(d[1])), sum(counts[w] > 0 for w in tokens(d[1])), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(d[1])), 3)) for d in docs)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 3)) for r in rows) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in rows)


def test_training_windows_cover_whole_texts():
    import numpy as np
    import pyarrow as pa

    texts = [prose(300, 900), "", None, prose(301, 5), "One\n" + prose(302, 40), prose(303, 700)]
    held = [False, False, False, False, False, True]
    got = lm_scoring._count(lm_scoring.TOKENIZERS)(pa.table({"block": [4] * 6, "held": held, "text": texts}))
    got = [np.frombuffer(x, "<u2").tolist() for x, k in zip(got["ids"].to_pylist(), got["kind"].to_pylist(), strict=True) if k == 2]
    enc, end, size = token_counts.encoding(), lm_scoring.END, lm_scoring.LENGTH
    want = []
    for t, h in zip(texts, held, strict=True):
        ids = [end, *(i for w in WORD.findall((t or "").translate(LOW)) for i in enc.encode_ordinary(" " + w)), end]
        for at in range(0, 0 if h else max(1, len(ids) - 1 - size + lm_scoring.STEP), lm_scoring.STEP):
            want.append((ids[at : at + size + 1] + [65535] * size)[: size + 1])
    assert sorted(got) == sorted(want)


def test_gradients():
    import numpy as np

    r = np.random.default_rng(0)
    m = lm_scoring.Model(r.integers(0, 50, lm_scoring.IDS), r.random(lm_scoring.IDS) < 0.5)
    w = {k: v.astype(np.float64) for k, v in m.w.items()}
    x = r.integers(0, lm_scoring.INPUTS, (2, lm_scoring.LENGTH))
    dy = r.standard_normal((2, lm_scoring.LENGTH, lm_scoring.STARTS + lm_scoring.REST))
    y, state = lm_scoring.forward(w, x)
    grads = lm_scoring.backward(w, x, dy, state)
    for k in ("Q", "O", "P", "U"):
        at = (1, 2)
        up, down = ({**w, k: w[k].copy()} for _ in range(2))
        up[k][at] += 1e-5
        down[k][at] -= 1e-5
        num = ((lm_scoring.forward(up, x)[0] - lm_scoring.forward(down, x)[0]) * dy).sum() / 2e-5
        assert abs(num - grads[k][at]) < 1e-3 * max(1, abs(num))


def test_near_dedup_against_brute_force(spark, edge):
    rows = OPS["op8"](spark, edge).collect()

    def shingles(t):
        w = WORD.findall((t or "").translate(LOW))
        return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else [])

    sets = [(d[0], shingles(d[1])) for d in edge_docs()]
    group = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(sets, group, strict=True):
        least[g] = min(least.get(g, math.inf), math.inf if i is None else i)
    want = sorted((str(i), len(s), str(None if least[g] == math.inf else least[g])) for (i, s), g in zip(sets, group, strict=True))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows) == want


def test_near_copies_without_an_id_link(spark):
    base = prose(420, 300).split()
    changed = lambda of: " ".join(w if k not in of else f"other{k}" for k, w in enumerate(base))
    first, second = range(10, 130, 8), range(150, 270, 8)
    rows = [(1, changed(first)), (None, changed(())), (None, changed(())), (3, changed(second)), (None, prose(421, 80)), (7, prose(422, 80))]
    rows += [(None, prose(423, 90)), (None, prose(423, 90) + " more")]
    found = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in found)
    assert got == {(1, 1): 1, (None, 1): 2, (3, 1): 1, (7, 7): 1, (None, None): 3}


def test_near_dedup_stage_takes_five_words(spark):
    base = prose(400, 300).split()
    loose = [w if k % 25 != 12 else f"other{k}" for k, w in enumerate(base)]
    close = [w if k != 150 else "other" for k, w in enumerate(base)]

    def share(a, b, n):
        a, b = ({tuple(x[k : k + n]) for k in range(len(x) - n + 1)} for x in (a, b))
        return len(a & b) / len(a | b)

    assert share(base, loose, 2) > 0.8 > share(base, loose, 5) and share(base, close, 5) > 0.8
    docs = spark.createDataFrame([doc(1, " ".join(base)), doc(2, " ".join(loose)), doc(3, " ".join(close))], DOCS)
    assert sorted(r["doc_id"] for r in near_dedup.stage(spark, docs, "").collect()) == [1, 2]


def test_token_counts(spark, edge):
    enc = token_counts.encoding()
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in OPS["op9"](spark, edge).collect())
    assert got == sorted((str(d[0]), len(enc.encode_ordinary(d[1] or ""))) for d in edge_docs())


def test_token_scan_across_small_blocks(spark, edge):
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    blocks, order = token_counts.write_flat(spark, docs, Scratch(spark, "t"), block_ids=7)
    got = order.join(token_counts.scan_counts(spark, blocks), ["file", "ordinal"]).agg(F.sum("n_tokens"), F.count("*")).first()
    enc = token_counts.encoding()
    assert tuple(got) == (sum(len(enc.encode_ordinary(d[1] or "")) for d in edge_docs()), len(edge_docs()))


def test_quality_statistics_against_brute_force(spark, edge):
    def base(t):
        t = t or ""
        w = WORD.findall(t)
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) for k in range(3) if c[tuple(w[i : i + 3])] > 1}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = OPS["op10"](spark, edge).collect()
    assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in rows) == sorted((str(d[0]), *base(d[1])) for d in edge_docs())
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_decision_list_is_learned():
    r = random.Random(4)
    rows = [((r.random(), r.random()), False) for _ in range(300)] + [((r.random() + 2, r.random()), True) for _ in range(80)]
    rules = quality_rules.learn(rows)
    assert rules and all(any(quality_rules._holds(x, f) for x in rules) == bad for f, bad in rows)


def test_pipeline(spark, edge):
    out = corpus_pipeline.run(spark, edge).collect()
    ids = {r["doc_id"] for r in out}
    assert 30 not in ids and 0 not in ids and 6 in ids and not ids & {7, 10, 11, 12}
