"""Alignment, best-fit packing and conversation repair against plain counterparts, and odd input."""

import hashlib
import random
import zlib
from bisect import insort
from collections import Counter

import numpy as np
import pytest
from llm_helpers import repair_plainly

from modaweave.llm import op11_alignment, op12_bestfit, op13_conversations, tokens
from modaweave.llm.op13_conversations import STATES, Turn
from modaweave.llm.queries import tokenizer

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
ODD = [
    None, "", "a", " ", "▁x", "<|endoftext|> x", "<s></s><unk>", "é é", "漢字かな\U0001f389" * 30, "a" * 5000, "\0x",
    "  a  b\n\n\tc ", "I'LL don't 'S", "ΑΣ İ ǅ", " " * 4000, "the՘ one", "9<|startoftext|>", "x" * 3001 + " y", "\x1c\x85 b",
]


# tokens


def test_word_ids_are_the_library_s():
    bpe = tokens.word_bpe(tokenizer())
    texts = ODD * 3
    random.Random(5).shuffle(texts)
    ids, at = bpe.of(texts, 2)
    assert bpe.fast is not None
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == [*bpe.tok.encode(t or "", add_special_tokens=False).ids, 2], t
    assert [x.tolist() for x in bpe.of([], 2)] == [[], [0]]


def test_word_ids_of_every_plain_character():
    bpe = tokens.word_bpe(tokenizer())
    texts = [f"a{c}b {c}{c} 1{c}2 .{c}. " for c in map(chr, range(1, 0xD800)) if not tokens._unusual(c)]
    ids, at = bpe.of(texts, 2)
    want = bpe.tok.encode_batch_fast(texts, add_special_tokens=False)
    assert all(ids[at[k] : at[k + 1] - 1].tolist() == e.ids for k, e in enumerate(want))


@pytest.mark.parametrize("plain", [False, True])
def test_byte_ids_are_the_library_s(plain, docs):
    bpe = tokens.byte_bpe(tokenizer(A), plain)
    assert bpe.fast is not None
    for t in [*ODD, *(r.text for r in docs.limit(100).collect())]:
        assert bpe.ids(t or "") == bpe.tok.encode(t or "", add_special_tokens=False).ids, t


# 11 alignment


def aligned_plainly(rows):
    """What op11 returns, from sets and dictionaries."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(tokenizer(A)), SentencePieceProcessor(model_file=tokenizer(B))
    a_model.encode_special_tokens = True
    back = tokens.byte_of_char()

    def b_bytes(i):
        return bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()

    found, count = [], Counter()
    for doc, t in rows:
        a = a_model.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_model.encode(t) if t else []
        x = [bytes(back[c] for c in a_model.id_to_token(i)) for i in a]
        y = [b_bytes(i) for i in b]
        if b"".join(x) != (" " + (t or "")).encode() or b"".join(y) != (" " + (t or "")).encode():
            a, b, x, y = [], [], [], []
        ends_a, ends_b = np.cumsum([len(z) for z in x]).tolist(), np.cumsum([len(z) for z in y]).tolist()
        groups, i, j, links = [], 0, 0, []
        for end in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(end, i), ends_b.index(end, j)
            groups.append(",".join(map(str, a[i : p + 1])) + "|" + ",".join(map(str, b[j : q + 1])))
            links.append((a[p], b[q]))
            i, j = p + 1, q + 1
        count.update(links)
        found.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    highest = {}
    for (_, b), n in count.items():
        highest[b] = max(highest.get(b, 0), n)
    return sorted(((d, x, y, g, len(s), sum(count[p] == highest[p[1]] for p in s), sum(count[p] for p in s), h) for d, x, y, g, s, h in found), key=repr)


def test_alignment(spark, docs, odd):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    own = spark.createDataFrame(list(enumerate(ODD, 10_000)), "doc_id long, text string")
    for df in (docs.select("doc_id", "text").limit(300).union(own), odd):
        got = op11_alignment.op11(df, tokenizer(A), tokenizer(B))
        assert got.columns == names
        want = aligned_plainly([(r.doc_id, r.text) for r in df.collect()])
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_alignment_groups_and_map(docs, empty):
    part = docs.limit(50)
    got = op11_alignment.alignment(part, tokenizer(A), tokenizer(B)).collect()
    both = op11_alignment.pair(tokenizer(A), tokenizer(B))
    for r in got:
        a, b, p, q = (np.frombuffer(x, "<i4").tolist() for x in (r.a_ids, r.b_ids, r.a_end, r.b_end))
        assert (len(a), len(b), len(p), len(q)) == (r.n_a, r.n_b, r.n_groups, r.n_groups)
        for i, j, k, m in zip([0, *p], p, [0, *q], q, strict=False):
            assert both.spell(0, a[i:j]) == both.spell(1, b[k:m])
    mapped = op11_alignment.token_map(part, tokenizer(A), tokenizer(B)).collect()
    assert sum(r.n for r in mapped) == sum(r.n_links for r in got)
    assert op11_alignment.op11(empty, tokenizer(A), tokenizer(B)).count() == 0


def test_shared_cuts():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 80, rng.integers(1, 40))) for _ in range(2))
        cuts = op11_alignment.shared_cuts(a, b, np.array([0]), np.array([len(a)]))
        assert a[cuts].tolist() == np.intersect1d(a, b).tolist()


# 12 best-fit packing


def best_fit(sizes, length):
    """Rooms left after best-fit, longest first, one document at a time."""
    rooms = []
    for size in sorted(sizes, reverse=True):
        at = next((k for k, r in enumerate(rooms) if r >= size), None)
        insort(rooms, (rooms.pop(at) if at is not None else length) - size)
    return rooms


def test_plan_is_best_fit():
    rng = random.Random(0)
    for _ in range(150):
        length = rng.choice([7, 16, 50, 200])
        counts = {k: rng.randint(1, 30) for k in rng.sample(range(1, length + 1), rng.randint(1, length))}
        bins, taken = {}, Counter()
        for size, lo, hi, first, each, offset in op12_bestfit.plan(counts, length):
            for r in range(lo, hi):
                bins.setdefault(first + (r - lo) // each, []).append((offset + (r - lo) % each * size, size))
                taken[size] += 1
        assert taken == counts
        for held in bins.values():
            end = 0
            for at, size in sorted(held):
                assert at == end
                end += size
        rooms = sorted(length - sum(s for _, s in held) for held in bins.values())
        assert rooms == best_fit([k for k, n in counts.items() for _ in range(n)], length)


def check_packing(rows, texts, length):
    bpe = tokens.byte_bpe(tokenizer(A))
    want = {i: [*bpe.tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    pieces, bins = {}, {}
    for r in rows:
        assert 0 < r.length <= length and zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, p in pieces.items():
        p.sort()
        assert [k for k, _, _ in p] == list(range(len(p))) and all(len(x) == length for _, _, x in p[1:])
        assert [s for _, s, _ in p] == np.cumsum([0, *(len(x) for _, _, x in p[:-1])]).tolist()
        assert sum((x for _, _, x in p), []) == want[i]
    assert set(pieces) == set(want)
    for held in bins.values():
        end = 0
        for at, n in sorted(held):
            assert at == end
            end += n
        assert end <= length
    sizes = [r.length for r in rows]
    assert len(bins) == len(best_fit(sizes, length))


def test_bestfit_round_trip(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    check_packing(op12_bestfit.pack(docs.repartition(5), tokenizer(A)).collect(), texts, 2048)


def test_bestfit_hot_length_and_odd(spark, odd, empty):
    rows = [(i, t) for i, t in enumerate([*ODD, *["same"] * 3000, *[None] * 500])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check_packing(op12_bestfit.pack(df, tokenizer(A), length=64).collect(), dict(rows), 64)
    got = op12_bestfit.op12(odd, tokenizer(A)).collect()
    bpe = tokens.byte_bpe(tokenizer(A))
    assert sum(r.length for r in got) == sum(len(bpe.ids(r.text or "")) + 1 for r in odd.collect())
    assert op12_bestfit.op12(empty, tokenizer(A)).count() == 0


# 13 conversations


def random_turns(rng, n):
    turns = [(rng.choice("uuaasx") if rng.random() > 0.05 else "", rng.random() < 0.2, rng.random() < 0.25) for _ in range(n)]
    return [Turn(r, gone, cut and not gone) for r, gone, cut in turns]


def test_repair_is_the_cheapest():
    rng = random.Random(3)
    for _ in range(3000):
        turns = random_turns(rng, rng.randint(0, 9))
        assert op13_conversations.repaired(turns) == repair_plainly(turns)
    long = random_turns(rng, 300)
    assert op13_conversations.repaired(long) == repair_plainly(long)


def test_chunks_join_to_the_whole():
    rng = random.Random(4)
    for _ in range(1500):
        turns, chunk = random_turns(rng, rng.randint(1, 10)), rng.randint(1, 4)
        parts = [op13_conversations.transitions(turns[k : k + chunk]) for k in range(0, len(turns), chunk)]
        ways = {"Z": (0, "")}
        for p in parts:
            new = {}
            for x, (cost, audit) in ways.items():
                for k, y in enumerate(STATES):
                    step = p[4 * STATES.index(x) + k]
                    if step and (y not in new or (cost + step[0], audit + step[1]) < new[y]):
                        new[y] = cost + step[0], audit + step[1]
            ways = new
        ends = [(c + 5 * len(op13_conversations.CLOSING[s]), a + op13_conversations.CLOSING[s]) for s, (c, a) in ways.items()]
        assert min(ends) == repair_plainly(turns)


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(9)
    words = ["Yes.", "No", "", " \n", "What is it?", "Well then!", "same words.", None]
    rows = [(7, t, rng.choice(["user", "assistant", "system", None, "tool"]), rng.choice(words)) for t in range(40)]
    rows += [(None, rng.choice([None, 1, 2, 3, 4]), rng.choice(["user", "assistant"]), f"{rng.choice(words)} {k % 9}.") for k in range(60)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {c} {t}.") for c in range(20, 60) for t in range(c % 6 + 1)]
    rows += [(99, t, "system" if t == 0 else "ua"[t % 2 == 0] + "x", f"Line {t % 17}.") for t in range(90)]
    return spark.createDataFrame([(*r, "x", 1.5) for r in rows], "conv_id long, turn long, role string, text string, here string, _rank double")


def test_large_conversations_are_repaired_alike(talks):
    rows = op13_conversations.damaged(talks)
    key = lambda r: (r[0] is None, r[0])
    whole = sorted(map(tuple, op13_conversations.repair(rows).collect()), key=key)
    parts = sorted(map(tuple, op13_conversations.repair(rows, most=5, chunk=4).collect()), key=key)
    assert whole == parts and len(whole) == 43
    edits = [sorted(map(tuple, op13_conversations.repair(rows, turns=True, **s).collect()), key=lambda r: (r[0] is None, r[0], r[1])) for s in ({}, {"most": 5, "chunk": 4})]
    assert [(r[0], *r[2:]) for r in edits[0]] == [(r[0], *r[2:]) for r in edits[1]]
    digest = {r[0]: r for r in whole}
    for conv in {r[0] for r in edits[0]}:
        told = [f"{r[3]}:{r[4]}" for r in edits[0] if r[0] == conv and r[2] != "D"]
        assert hashlib.sha256("\n".join(told).encode()).hexdigest() == digest[conv][8]


def test_repair_odd(spark, talks):
    import duckdb

    from modaweave.llm.queries import SQL

    con = duckdb.connect()
    con.register("given", talks.toPandas())
    con.execute("CREATE VIEW conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM given")
    want = con.execute(SQL["op13_conversations"])
    names = [c[0] for c in want.description]
    got = [tuple(r[c] for c in names) for r in op13_conversations.op13(talks).collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)
    assert op13_conversations.op13(talks.limit(0)).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    r = op13_conversations.op13(spark.createDataFrame([(dropped, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(x) for x in r] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
