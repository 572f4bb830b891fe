"""Operators on texts against brute force, whole texts included that are odd."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
from conftest_llm import ODD, documents  # noqa: F401
from tokenizers import Tokenizer

from tablelens.llm import windows
from tablelens.llm.bpe import TextBpe, encode_texts, read_ranks
from tablelens.llm.bwt import dedup_bytes, repeated_places
from tablelens.llm.encoding import TextEncoder
from tablelens.llm.fmindex import FmIndex, dedup_substrings
from tablelens.llm.idfiles import ShardReader, read_id_files, write_id_files
from tablelens.llm.minhash import chance, near_duplicates, registers
from tablelens.llm.packing import Limits, VectorPacker, pack_documents, pack_stream
from tablelens.llm.winnowing import compare_edited
from tablelens.llm.words import shingle_set

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
dice = random.Random(5)
VOCABULARY = ["".join(dice.choice("abcdeéinors") for _ in range(dice.randint(1, 8))) for _ in range(400)]


def prose(n, dice=dice):
    return " ".join(dice.choice(VOCABULARY) for _ in range(n))


def corpus():
    """Unrelated texts, copies, near copies and shared passages."""
    passage, out = prose(60), [t for t in ODD if t[0] is not None]
    for i in range(20, 50):
        out.append((i, prose(dice.randint(1, 250))))
    for i in range(50, 60):
        words = out[15][1].split()
        words[dice.randrange(len(words))] = "changed"
        out.append((i, " ".join(words)))
    for i in range(60, 75):
        out.append((i, f"{prose(30)} {passage} {prose(dice.randint(0, 30))}"))
    out += [(i, prose(40) + " " + passage.upper()) for i in range(75, 78)] + [(80, out[12][1]), (81, out[12][1])]
    return out


def text_of(text):
    return text or ""


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_tokens_of_pieces_are_those_of_whole_texts():
    encoder = TextEncoder(JSON)
    texts = [text_of(t) for _, t in corpus()] + [prose(20) + m for m in ("  ", " \n x", "'s y", ".,! z", "1a2 b")]
    want = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == want
    assert [x.tolist() for x in encoder.encode(texts)] == want  # now known


def test_monoid_equals_direct_merging(spark, documents):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    bpe = TextBpe(RANKS, P.PATTERN)
    long = ["".join(dice.choice(a) for _ in range(3_000)) for a in ("ab", "ent ier", "0123456789", "!?.", "é日 \n")]
    for text in long:
        assert bpe.encode(text)[0] == library.encode_ordinary(text)
    a, b, c = (library.encode_ordinary(x) for x in ("abcab", "cabab", "bbca"))
    join = bpe.merges.join
    assert join(join(a, b), c) == join(a, join(b, c)) == bpe.merges.encode(b"abcabcababbbca")
    got = {r.doc_id: r for r in encode_texts(documents(*corpus()), RANKS, P.PATTERN).collect()}
    for i, text in corpus_now(got):
        ids = library.encode_ordinary(text)
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded_sha256 == sha(text.encode())


def corpus_now(got):
    return [(i, text_of(t)) for i, t in ODD if i in got]


def test_substrings_against_brute_force(documents):
    rows, seen, want = corpus(), set(), {}
    for i, text in sorted(rows):
        words = text_of(text).encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - 19):
            window = tuple(words[p : p + 20])
            if window in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        want[i] = (len(words), sum(gone), sha(kept), kept.decode())
    got = {r[0]: tuple(r)[1:] for r in dedup_substrings(documents(*rows)).collect()}
    assert got == want
    assert sum(w[1] > 0 for w in want.values()) > 15


def test_index_finds_every_window():
    text = np.array([1, 2, 3, 1, 2, 3, 4, 0, 2, 3, 1, 2, 0], np.int64)
    index = FmIndex(text, 5, 3)
    found = index.matches(text, np.array([0, 8]), np.array([7, 4]))
    for i in range(len(text) - 2):
        for j in range(len(text) - 2):
            if 0 not in text[i : i + 3] and 0 not in text[j : j + 3]:
                assert (found[i] == found[j]) == (text[i : i + 3].tolist() == text[j : j + 3].tolist())


def brute_bytes(rows, window):
    datas = {i: text_of(t).encode() for i, t in rows}
    count = Counter(d[p : p + window] for d in datas.values() for p in range(len(d) - window + 1))
    want = {}
    for i, d in datas.items():
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - window + 1):
            if count[d[p : p + window]] > 1:
                gone[p : p + window] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[i] = (len(d), int(gone.sum()), spans, sha(np.frombuffer(d, np.uint8)[~gone].tobytes()))
    return want


@pytest.mark.parametrize("window", [400, 64])
def test_bytes_against_brute_force(documents, window):
    rows = [(i, t if t is None or len(t) < 5_000 else t[:5_000]) for i, t in corpus()]
    got = {r[0]: tuple(r)[1:5] for r in dedup_bytes(documents(*rows), window).collect()}
    want = brute_bytes(rows, window)
    assert got == want
    assert sum(w[1] > 0 for w in want.values()) > 3


def edges(n=300):
    """A passage with other words before and behind it in each text; some texts are equal."""
    passage = prose(120)
    rows = [(i, f"{prose(60)} {passage} {prose(60)}") for i in range(n)]
    return rows + [(n, passage), (n + 1, rows[7][1]), (n + 2, rows[7][1] + " end"), (None, rows[9][1]), *rows[20:22], *ODD[:-2]]


@pytest.mark.parametrize("operator", ["words", "bytes"])
def test_hot_anchors_change_no_result(documents, monkeypatch, operator):
    rows = edges(60)
    run = dedup_substrings if operator == "words" else dedup_bytes
    want = sorted(map(tuple, run(documents(*rows)).collect()), key=repr)
    monkeypatch.setattr(windows, "SAMPLE", 1)
    for least in (1, 5):
        monkeypatch.setattr(windows, "HOT_PIECES", least)
        assert sorted(map(tuple, run(documents(*rows)).collect()), key=repr) == want
    assert sum(w[2] > 0 for w in want) > 60


@pytest.mark.parametrize(("kind", "window"), [(windows.Words, 20), (windows.Bytes, 400)])
def test_edges_of_a_common_passage_are_dealt_out(documents, monkeypatch, kind, window):
    monkeypatch.setattr(windows, "SAMPLE", 1)
    monkeypatch.setattr(windows, "PORTION_BYTES", 10_000)
    monkeypatch.setattr(windows, "PORTION_WINDOWS", 5_000)
    docs, most = documents(*edges()).where("text IS NOT NULL"), Counter()
    hot = windows.hot_anchors(docs, kind, window)
    assert 0 < len(hot) < 100

    def decide(pieces):
        most.update(pieces.anchor.tolist())
        return pieces.doc, pieces.start, pieces.windows

    batches = docs.select("doc_id", "text").toArrow().to_batches()
    sent = list(windows._send(iter(batches), kind, window, 8, hot))
    answers = list(windows._answer(iter(sent), decide, 8, False))
    assert max(most.values()) < 100
    # The first text has all its windows, each once.
    doc, start, n = windows.read_ranges([p for b in answers for p in b.column("packed").to_pylist()])
    (text,) = (r.text for r in docs.where("doc_id = 0").collect())
    mine = sorted(x for s, k in zip(start[doc == 0], n[doc == 0], strict=True) for x in range(s, s + k))
    assert mine == list(range(kind.units(text.encode())[1] - window + 1))


def test_a_task_answers_each_home_once(documents, monkeypatch):
    monkeypatch.setattr(windows, "SAMPLE", 1)
    docs = documents(*edges()).where("text IS NOT NULL")
    hot = windows.hot_anchors(docs, windows.Bytes, 400)
    batches = docs.select("doc_id", "text").toArrow().to_batches()
    rows = [r for b in windows._send(iter(batches), windows.Bytes, 400, 8, hot) for r in b.to_pylist()]
    rows.sort(key=lambda r: (r["bucket"], r["single"]))
    assert len({(r["bucket"], r["single"]) for r in rows}) == 16
    sent = pa.RecordBatch.from_pylist(rows)
    for most in (10**6, 100):
        monkeypatch.setattr(windows, "ANSWER_RANGES", most, raising=False)
        answers = list(windows._answer(iter([sent]), lambda p: (p.doc, p.start, p.windows), 5, True))
        packed = [p for b in answers for p in b.column("packed").to_pylist()]
        if most == 10**6:
            assert len(packed) == 5
            want = windows.read_ranges(packed)
        assert all((a == b).all() for a, b in zip(windows.read_ranges(packed), want, strict=True))


def test_texts_are_finished_a_few_at_a_time(documents, monkeypatch):
    rows = edges(60)
    want = sorted(map(tuple, dedup_bytes(documents(*rows)).collect()), key=repr)
    monkeypatch.setattr(windows, "FINISH_ROWS", 3)
    assert sorted(map(tuple, dedup_bytes(documents(*rows)).collect()), key=repr) == want


def test_line_breaks_cut_texts(monkeypatch):
    """Words beside a line break are looked up apart, with the ids of the whole text."""
    lines = [f"{w}.\n{w.capitalize()} {w},\n{w}" for w in VOCABULARY]
    odd = ["", "\n", "\nab", "ab\n", "a\nb\n", "\n\nab", "a\n\nb", "a.\n\nb\nc d", "a\n\n", "a \nb c", "a\n b", " a\nb", "a\nb "]
    odd += ["a  b\nc d\ne", "x\ty\nz w", "a\n\t b", "'s\n's 't\n12\n,,\n'", "ñ\né é\n日本 語\nx", "a\r\nb c", "w\n" * 90 + "q" * 99]
    own = TextEncoder(JSON)
    asked, learn = [], own._learn
    monkeypatch.setattr(own, "_learn", lambda pieces: (asked.extend(pieces), learn(pieces))[1])
    library = Tokenizer.from_file(JSON)
    for texts in (lines, odd, lines + odd, odd[::-1], [f"{a}\n{b} {a}" for a, b in zip(odd, odd[::-1], strict=True)]):
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [i.tolist() for i in own.encode(texts)] == want
        if texts is lines:
            assert len(asked) <= 5 * len(VOCABULARY) and not any("\n" in p[1:] for p in asked)


@pytest.mark.parametrize("operator", [dedup_substrings, dedup_bytes])
def test_the_largest_id_is_not_taken_for_a_missing_one(documents, operator):
    own = random.Random(9)
    passage = prose(200, own)
    rows = [(5, passage), (2**63 - 1, prose(80, own)), (None, f"{prose(200, own)} {passage}")]
    want = {r[0]: tuple(r)[1:] for r in operator(documents((5, passage), (6, rows[1][1]), (7, rows[2][1]))).collect()}
    got = {r[0]: tuple(r)[1:] for r in operator(documents(*rows)).collect()}
    assert got == {5: want[5], 2**63 - 1: want[6], None: want[7]}
    assert want[6][1] == 0 < want[7][1]


def test_merged_transforms_count_all_strings():
    contents = [bytes(dice.choice(b"ab") for _ in range(dice.randint(64, 200))) for _ in range(9)]
    contents += [contents[0][20:120], b"a" * 150]
    contents = list(dict.fromkeys(contents))
    weight = np.ones(len(contents))
    owner, offset, total = repeated_places(contents, weight, 64)
    count = Counter(c[p : p + 64] for c in contents for p in range(len(c) - 63))
    assert len(owner) == sum(count.values())
    assert all(total[k] == count[contents[o][p : p + 64]] for k, (o, p) in enumerate(zip(owner, offset, strict=True)))


def test_near_duplicates_against_brute_force(documents):
    rows = corpus()
    sets = {i: set(shingle_set(text_of(t), 5).tolist()) for i, t in rows}
    want = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= 75 * len(x | y) and want[a] != want[b]:
                    want[a] = want[b] = min(want[a], want[b])
                    changed = True
    got = {r.doc_id: r for r in near_duplicates(documents(*rows, (None, "no id at all"))).collect()}
    alone = got.pop(None)
    assert alone.kept and alone.component_id is None
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {
        i: (len(s), want[i], want[i] == i) for i, s in sets.items()
    }
    assert sum(i != c for i, c in want.items()) > 8


def test_registers_agree_as_often_as_sets_do():
    random = np.random.default_rng(1)
    shares = []
    for _ in range(200):
        both, a, b = (random.integers(0, 2**64, n, np.uint64) for n in (600, 100, 100))
        x, y = (registers(np.unique(np.concatenate([both, z]))) for z in (a, b))
        shares.append((x == y).mean())
    assert abs(np.mean(shares) - 0.75) < 0.02
    apart = [
        (registers(np.sort(random.integers(0, 2**64, 600, np.uint64))) == registers(np.sort(random.integers(0, 2**64, 600, np.uint64)))).mean()
        for _ in range(300)
    ]
    assert np.mean(apart) < 3 * chance(np.array(600), np.array(600)) + 1e-3


def test_edited_texts(documents):
    rows = corpus()
    got = {r.doc_id: r for r in compare_edited(documents(*rows)).collect()}
    order = sorted((i for i, _ in rows), reverse=True)
    texts = {i: text_of(t) for i, t in rows}
    for i, after in zip(order, order[1:] + order[:1], strict=True):
        third = len(texts[i]) // 3
        edited = texts[i][: len(texts[i]) - third] + texts[after][:third]
        assert got[i].n_chars == len(texts[i]) and got[i].edited_sha256 == sha(edited.encode())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[5].fingerprint == got[9].fingerprint
    assert np.mean([got[i].near_edited for i in range(20, 50)]) > 0.3
    shared = compare_edited(documents((1, prose(60)), (2, "one " + prose(1)))).collect()
    assert len(shared) == 2


def brute_winnowing(text, gram=4, window=8):
    """``(place, tokens)`` of the kept grams, by comparing all windows of a text."""
    tokens = regex.findall(r"[\p{L}\p{M}]{1,16}|\p{N}{1,16}|[^ \t\n\x0b\f\r\p{L}\p{M}\p{N}]{1,16}", text)
    grams = [tuple(tokens[i : i + gram]) for i in range(len(tokens))]
    return tokens, grams


def test_fingerprints_against_brute_force(documents):
    """Hashes are the library's; which grams are kept, where they stand and how alike two
    texts are is recomputed from the definition."""
    rows = [(i, t) for i, t in corpus() if i is not None][:150]
    got = {r.doc_id: r for r in compare_edited(documents(*rows)).collect()}
    ordered = sorted(rows, key=lambda r: -r[0])
    kept = {}

    def decoded(fingerprint):
        place, out = -1, []
        for at in range(0, len(fingerprint), 10):
            place += int(fingerprint[at : at + 2], 16)
            out.append((place, fingerprint[at + 2 : at + 10]))
        return out

    for k, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == sha(edited.encode())
        kept[i] = decoded(got[i].fingerprint)
        for print_, of in ((kept[i], text), (decoded(got[i].edited_fingerprint), edited)):
            _, grams = brute_winnowing(of)
            places = [p for p, _ in print_]
            assert places == sorted(set(places)) and (not places or places[-1] < len(grams))
            by_hash, by_gram = {}, {}
            for p, h in print_:  # equal grams have equal hashes, and in these texts only they do
                assert by_hash.setdefault(h, grams[p]) == grams[p] and by_gram.setdefault(grams[p], h) == h
            # Every window of eight grams holds a kept one; a short text keeps one.
            assert all(any(a <= p < a + 8 for p in places) for a in range(max(len(grams) - 7, min(len(grams), 1))))
        own, other = ({h for _, h in x} for x in (kept[i], decoded(got[i].edited_fingerprint)))
        assert got[i].near_edited == pytest.approx(len(own & other) / len(own | other) if own | other else 1.0)
    for k, (i, _) in enumerate(ordered):
        own, other = ({h for _, h in kept[j]} for j in (i, ordered[(k + 1) % len(ordered)][0]))
        assert got[i].near_next == pytest.approx(len(own & other) / len(own | other) if own | other else 1.0)


def test_rows_of_one_id_are_documents_of_their_own(documents):
    rows = [(1, prose(30)), (1, prose(40)), (1, None), (2, prose(20)), (None, "x"), (None, "x")]
    got = compare_edited(documents(*rows)).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t in rows)


def test_packing_loses_nothing(documents):
    rows = [*corpus(), *[t for t in ODD if t[0] is None]]
    library = Tokenizer.from_file(JSON)
    limits = Limits(tokens=256, segments=4, loss_tokens=200, open_sequences=8)
    pieces = pack_documents(documents(*rows), JSON, limits=limits).toPandas()
    for i, text in rows:
        mine = pieces[pieces.doc_id.isna() if i is None else pieces.doc_id == i].sort_values("start")
        ids = library.encode(text_of(text), add_special_tokens=False).ids + [1]
        assert np.frombuffer(b"".join(mine.ids), "<u4").tolist() == ids
        assert all(zlib.crc32(d) == c for d, c in zip(mine.ids, mine.ids_crc32, strict=True))
    for _, one in pieces.groupby("sequence_id"):
        one = one.sort_values("offset")
        assert one.offset.tolist() == [0, *one.length.cumsum().tolist()[:-1]]
        assert one.length.sum() <= 256 and len(one) <= 4 and one.loss_tokens.sum() <= 200


def test_open_sequences_are_completed_and_not_laid_anew():
    limits, random = Limits(tokens=2048, open_sequences=16), np.random.default_rng(2)
    items = [np.ones(n, np.int8) for n in random.integers(1, 1_500, 400).tolist()]
    packer, placed = VectorPacker(limits), {}
    for i, loss in enumerate(items):
        for item, start, n, name, offset in packer.add(i, loss):
            placed[item, start] = (n, name, offset)
    got, fill, kept = {}, Counter(), 0
    for item, start, n, name, offset in pack_stream(((i, x) for i, x in enumerate(items)), limits, 0):
        assert offset == fill[name]
        fill[name] += n
        got.setdefault(item, []).append((start, n))
        kept += n if placed.get((item, start)) == (n, name, offset) else 0
    for i, loss in enumerate(items):
        starts = np.cumsum([0, *[n for _, n in sorted(got[i])]]).tolist()
        assert [s for s, _ in sorted(got[i])] == starts[:-1] and starts[-1] == len(loss)
    assert all(f == 2048 or f & (f - 1) == 0 for f in fill.values())
    assert kept > 0.95 * sum(map(len, items))


def test_packing_prefers_the_larger_dot_product():
    packer = VectorPacker(Limits(100, 9, 100, 4))
    where = {}
    for i, n in enumerate((60, 50, 40, 10)):
        for item, _, _, sequence, _ in packer.add(i, np.ones(n, np.int8)):
            where[item] = sequence
    # 40 fits both sequences; more is left of every limit in the second.
    assert where == {0: 0, 1: 1, 2: 1, 3: 0}


def test_id_files_round_trip(spark, documents, tmp_path):
    rows = [*corpus(), *[t for t in ODD if t[0] is None]]
    files = write_id_files(documents(*rows), f"file://{tmp_path}", JSON)
    got = read_id_files(files).collect()
    encoder, at = TextEncoder(JSON), 0
    for r in sorted(got, key=lambda r: r.start):
        text = text_of(dict(rows)[r.doc_id])
        ids = [*encoder.encode([text])[0].tolist(), 2]
        assert r.start == at and np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        at += len(ids)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, *sorted(i for i, _ in rows if i is not None)]
    one = files.collect()[-1]
    dictionary = open(one.dictionary.removeprefix("file://"), "rb").read()
    reader = ShardReader(one.path, dictionary)
    assert reader.find(int(reader.ids[-1])).tolist() == reader.tokens(reader.n - 1).tolist()
    with pytest.raises(ValueError):
        ShardReader(one.path, dictionary + b"x")


@pytest.mark.parametrize(
    "operator",
    [
        dedup_substrings,
        dedup_bytes,
        near_duplicates,
        compare_edited,
        lambda d: pack_documents(d, JSON),
        lambda d: encode_texts(d, RANKS, P.PATTERN),
    ],
)
def test_empty_and_repeated(documents, operator):
    assert operator(documents()).collect() == []
    got = operator(documents((1, "one two three"), (1, "one two three"), (None, None), (None, None))).collect()
    assert {r[0] for r in got} == {1, None}
