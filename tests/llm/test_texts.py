"""Quality rules, tokenization, packing and chat against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tallymark.llm import automaton, chat, packing, quality_rules
from tallymark.llm.tokenizer import parse, read


def measures(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
    seen, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            inside.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    chars, capitals = sum(map(len, ws)), sum(c.isupper() for c in text or "")
    symbols, again, n = sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(ws)
    failed = n < 10 or 100 * len(inside) > 20 * n
    kept = not (failed or 10 * symbols > 3 * n or 10 * again > 3 * len(lines) or 10 * capitals > 3 * chars
                or not 2 * n <= chars <= 15 * n)
    return n, chars, symbols, again, len(inside), failed, kept


def test_rules_match_a_plain_count(docs, rows):
    found = Counter(tuple(r)[:8] for r in quality_rules.measure(docs).drop("rejected_by").collect())
    assert found == Counter((k, *measures(t)) for k, t in rows)


def test_good_documents_keep_all_their_columns(docs, rows):
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text, r.n) for r in kept.collect()) == Counter(
        (k, t, 1) for k, t in rows if measures(t)[-1])


def test_rules_of_an_empty_table(no_docs):
    assert quality_rules.measure(no_docs).count() == 0 and quality_rules.keep_good(no_docs).count() == 0


@pytest.fixture(scope="module")
def library(tokenizer):
    return Tokenizer.from_file(tokenizer)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aabehnst THE\n\t'\"é漢🎉́\x85\xa0  019<|>!.")), max_size=80), max_size=5))
def test_automaton_gives_the_library_s_ids(texts):
    from public_tokenizers import path
    bpe, lib = automaton.compiled(read(path("byte_bpe_50k.json"))), Tokenizer.from_file(path("byte_bpe_50k.json"))
    flat, size = bpe.encode_batch(texts)
    for text, end, n, spelled in zip(texts, np.cumsum(size).tolist(), size.tolist(), bpe.spell(flat, size), strict=True):
        ids = flat[end - n: end].tolist()
        assert ids == lib.encode(text, add_special_tokens=False).ids == bpe.bpe.encode(text)
        assert spelled == lib.decode(ids, skip_special_tokens=False)
    broken = np.concatenate([flat[::3], flat[1::7], np.arange(300)]).astype(np.int32)
    assert bpe.spell(broken, np.array([len(broken), 0])) == [lib.decode(broken.tolist(), skip_special_tokens=False), ""]


def test_words_move_from_the_old_memory_to_the_young(tokenizer, library, monkeypatch):
    monkeypatch.setattr(automaton, "REMEMBERED", 60)
    bpe, rnd = automaton.Automaton(parse(read(tokenizer))), random.Random(8)
    words = ["".join(rnd.choice("aeinrst") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    for _ in range(40):
        texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))) + "<|endoftext|>" for _ in range(4)]
        flat, size = bpe.encode_batch(texts)
        expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert flat.tolist() == [k for ids in expected for k in ids] and size.tolist() == [len(ids) for ids in expected]
    assert len(bpe.young.number) < 200 and bpe.old.number


def test_long_words_are_read_like_short_ones(tokenizer, library):
    bpe, rnd = automaton.compiled(read(tokenizer)), random.Random(2)
    for _ in range(60):
        word = "".join(rnd.choice("aetonhérstç") for _ in range(rnd.randint(1, 40))).encode()
        flat, count = bpe.read_words([word])
        assert bpe.read_long(word) == flat.tolist() == library.encode(word.decode(), add_special_tokens=False).ids
        assert count.tolist() == [len(flat)]
    assert [k for k in bpe.read_long(b"ab" * 500_000)] == library.encode("ab" * 500_000, add_special_tokens=False).ids


def test_table_and_gadgets_tell_the_same_arcs(tokenizer):
    bpe, rnd = automaton.compiled(read(tokenizer)), np.random.default_rng(1)
    u, t = rnd.integers(0, automaton.TABLED, 200_000), rnd.integers(0, automaton.TABLED, 200_000)
    common = [k for k, label in enumerate(bpe.labels[:automaton.TABLED]) if len(label) < 4]
    u[:100_000], t[:100_000] = rnd.choice(common, 100_000), rnd.choice(common, 100_000)
    assert (bpe.arcs(u, t) == bpe._arc_by_gadgets(u, t)).all() and not bpe.arcs(u, t).all()
    assert [bpe.arc(int(a), int(b)) for a, b in zip(u[:500], t[:500])] == bpe.arcs(u[:500], t[:500]).tolist()
    rare = rnd.integers(automaton.TABLED, 50_000, 5_000)
    assert (bpe.arcs(rare, t[:5_000]) == bpe._arc_by_gadgets(rare, t[:5_000])).all()


@pytest.mark.parametrize("spaces", [" " * 2_000_000, "\n" * 1_100_000, "\u3000" * 400_000, " \n\t" * 500_000])
def test_very_long_white_space_is_encoded(tokenizer, library, spaces):
    bpe = parse(read(tokenizer))
    for text in (spaces, f"one{spaces}two", f"{spaces}, x{spaces}<|im_end|>{spaces}<|endoftext|>y"):
        assert bpe.encode(text) == library.encode(text, add_special_tokens=False).ids
        assert b"".join(map(bpe.labels.__getitem__, bpe.encode_plain(text))).decode() == text


def test_cuts_of_white_space_change_no_id(tokenizer, library, monkeypatch):
    bpe, rnd = parse(read(tokenizer)), random.Random(4)
    monkeypatch.setattr("tallymark.llm.tokenizer.LONG_SPACE", re.compile(r"\s{3,}"))
    for _ in range(400):
        text = "".join(rnd.choice([" ", " ", "\n", "\t", "\u3000", "a", "Be", "'s", "7", "!", "<|endoftext|>"]) for _ in range(30))
        assert bpe.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_long_white_space_packs_and_formats(spark, tokenizer):
    text = "one" + " " * 1_200_000 + "two"
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    assert {r.doc_id for r in packing.pack(docs, tokenizer).collect()} == {1, 2}
    turns = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn int, role string, text string")
    row, = chat.digests(chat.format_turns(turns, tokenizer), tokenizer).collect()
    assert row.n_turns == 2 and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_arcs_are_those_of_the_explicit_construction():
    from tallymark.llm.tokenizer import ByteBpe
    rnd = random.Random(3)
    for _ in range(20):
        labels, merges = [bytes([b]) for b in range(3)], []
        while len(merges) < 12:
            a, b = rnd.randrange(len(labels)), rnd.randrange(len(labels))
            if labels[a] + labels[b] not in labels:
                merges.append((a, b, len(labels)))
                labels.append(labels[a] + labels[b])
        out, target = {0: set(range(3))}, {k: 0 for k in range(3)}  # arcs of each state, state of each label
        for u, v, uv in merges:
            q, r, new = target[u], target[v], len(out)
            if v in out[q]:
                out[new] = out[q] - {v}
                target[u] = new
                for state in out.values():
                    if u in state:
                        state.add(uv)
            target[uv] = r
        # A label that no state offers cannot be read; all others must agree.
        offered = set().union(*out.values())
        made = automaton.Automaton.__new__(automaton.Automaton)
        made.bpe = ByteBpe(labels, merges, {})
        made.labels, size = labels, len(labels)
        made.left, made.right, made.born = (np.full(size, -1), np.full(size, -1), np.zeros(size, np.int64))
        for k, (u, v, uv) in enumerate(merges, 1):
            made.left[uv], made.right[uv], made.born[uv] = u, v, k
        keys = np.array([u * size + v for u, v, _ in merges])
        order = np.argsort(keys)
        made.gadgets, made.rank = keys[order], order + 1
        if len(offered) == size:
            table = automaton.arc_table(merges, np.arange(3), size)
            for u in range(size):
                for t in range(size):
                    assert bool(made._arc_by_gadgets(np.array([u]), np.array([t]))[0]) == (t in out[target[u]])
                    assert bool(table[u, t >> 3] >> (t & 7) & 1) == (t in out[target[u]])


def test_encoding_and_decoding_a_table(docs, rows, tokenizer, library, no_docs):
    coded = automaton.decode(automaton.encode(docs, tokenizer), tokenizer)
    once = automaton.encode(docs, tokenizer, decoded="decoded")
    assert once.columns == coded.columns and once.exceptAll(coded).count() == coded.exceptAll(once).count() == 0
    assert coded.columns == [*docs.columns, "ids", "decoded"]
    found = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in coded.collect())
    assert found == Counter(
        (k, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for k, t in rows)
    assert automaton.encode(no_docs, tokenizer).count() == 0


@pytest.mark.parametrize("seed,n", [(1, 3), (2, 400), (3, 30000)])
def test_plans_place_every_length(seed, n):
    histogram = np.bincount(np.random.default_rng(seed).integers(1, 129, n), minlength=129)
    used, placed = packing.plan(histogram), np.zeros(129, int)
    for row, times in used:
        assert sum(row) <= 128
        for length in row:
            placed[length] += times
    assert (placed == histogram).all()
    least = -(-int((histogram * np.arange(129)).sum()) // 128)
    assert sum(t for _, t in used) <= least * 1.06 + 1


def test_packing_a_table(docs, rows, tokenizer, library, no_docs):
    made = packing.pack(docs, tokenizer, size=256, with_ids=True).toPandas()
    ids = defaultdict(list)
    for k, t in rows:
        ids[k].append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    expected = Counter()
    for k, many in ids.items():
        for one in many:
            for n, (start, length) in enumerate(packing.cut(len(one), 256)):
                part = np.array(one[start:start + length], "<u4")
                expected[k, n, start, length, zlib.crc32(part.tobytes())] += 1
    found = Counter((None if k != k else k, *r) for k, *r in made[
        ["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))
    assert found == expected
    for _, one in made.sort_values("offset").groupby("sequence_id"):
        assert one["offset"].tolist() == [0, *one["length"].cumsum().tolist()[:-1]] and one["length"].sum() <= 256
    assert packing.pack(no_docs, tokenizer).count() == 0
    assert packing.cut(256, 256) == [(0, 256)] and packing.cut(600, 256) == [(0, 88), (88, 256), (344, 256)]


@given(st.text(alphabet=st.sampled_from(list("<|\\n\nim_endstar>a")), max_size=40))
def test_escapes_can_be_undone(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_conversations_read_back(spark, tokenizer):
    rows = [(1, 0, "user", "hi <|im_end|>", "x"), (1, 1, "assistant", "a\\|<\\|b|", "x"), (1, 2, "assistant", None, "x"),
            (1, 3, "assistant", "<", "x"), (1, 4, "assistant", "|é漢", "x"), (2, None, None, "t", "x"), (2, 0, "a\nb", "", "x"),
            (2, 0, "a\nb", "", "x"), (None, 0, "assistant", "nobody", "x"), (3, 0, "user", "long " * 30000, "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids string").repartition(3)
    turns = chat.format_turns(frame, tokenizer)
    found = {r.conv_id: tuple(r)[1:] for r in chat.digests(turns, tokenizer).collect()}
    expected = {}
    for conv in (1, 2, 3, None):
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: -1 if r[1] is None else r[1])
        said = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for role, t in said if role == "assistant")
        chars = sum(len(f"<|im_start|>{chat.escape_role(a)}\n{chat.escape(b)}<|im_end|>\n") for a, b in said)
        expected[conv] = (len(own), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest(), len(loss),
                          hashlib.sha256(loss.encode()).hexdigest(), chars)
    assert found == expected
    start, end = chat.marks(parse(read(tokenizer)))
    assert all(r.ids[0] == start and r.ids.count(start) == r.ids.count(end) == 1 for r in turns.collect())
    assert chat.digests(chat.format_turns(frame.limit(0), tokenizer), tokenizer).count() == 0
