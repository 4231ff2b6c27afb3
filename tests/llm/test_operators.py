"""Small tables with the odd cases, each operator against a plain version of itself."""

import hashlib
import os
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from tablewright.llm import language, lines, minhash, packing, pieces, quality, rules, search, similar, toxicity, urls  # noqa: E402
from tablewright.llm.queries import URL_RULES, tokenizer_path  # noqa: E402
from tablewright.llm.tables import held_out  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, component_id long, rank int"
BASE = " ".join(f"word{i}" for i in range(60))
ODD = [
    (1, BASE), (2, BASE), (3, BASE.replace("word7 ", "other ")), (4, None), (5, ""), (6, " \n\t "), (7, "three words only"),
    (8, "three words only"), (9, BASE + "\n" + BASE), (None, BASE), (10, "x" * 70_000 + " end"), (10, "x" * 70_000 + " end"),
    (11, "ÄÖ é 日本 \U0001f600 ​ it's 12 <|endoftext|> </s> a  b"), (12, "one\n\n" + BASE + "\n \nlast line of it"), (-5, BASE.upper()),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if k % 2 else None, None, None if t is None else len(t), "s", 0, 1) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(300)] + [(None, 1, 1), (3, None, None), (5, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def labelled(spark):
    """Ordinary and shouting documents, with insults in half of each."""
    rows = []
    for i in range(300):
        words = [f"{'abcdefgh'[(i * 7 + k) % 8]}o{'rstlmn'[(i + k * k) % 6]}e{k % 9}a" for k in range(40)]
        words = words if i % 2 else [w.upper() + "!!###" for w in words]
        rows.append((i, " ".join([*words[:20], *(["idiot", "stup1d", "mоron"] if (i // 2) % 2 else []), *words[20:]]),
                     "xa" if i % 3 else "xb"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def components(sets, percent):
    found = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and found[a] != found[b]:
                    found[a] = found[b] = min(found[a], found[b])
                    changed = True
    return found


def test_encoding_equals_the_library(odd, none):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    expected = []
    for i, t in ODD:
        ids = library.encode(t or "")
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, pieces.encode_texts(odd, path).collect()), key=str) == sorted(expected, key=str)
    assert pieces.encode_texts(none, path).count() == 0
    codec = pieces.PieceCodec(path)
    draw = np.random.default_rng(1)
    letters = list(" ▁\n\r\tabehtions.,é日😀<0xA>\x00")
    for _ in range(500):
        text = "".join(draw.choice(letters, draw.integers(0, 40)))
        assert codec.encode(text).tolist() == library.encode(text)
        ids = draw.choice([28705, 3, 200, 130, 259, 264, 31000, 150], 6).tolist()
        assert codec.decode_bytes(ids) == library.decode(ids).encode()


def test_near_duplicates_equal_brute_force(odd, none):
    for percent in (80, 85):
        rows = minhash.near_duplicates(odd, percent).collect()
        sets = {i: shingle_set(t) for i, t in ODD if i is not None}
        expected = components(sets, percent)
        assert len(rows) == len(ODD)
        for r in rows:
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"]
            else:
                assert r["component_id"] == expected[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"])
                assert r["n_shingles"] == len(sets[r["doc_id"]])
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 10").count() == 1 and kept.where("doc_id is null").count() == 1


def test_near_copies_without_a_common_centre(spark):
    """A chain: each text is near the next, the ends are far from each other."""
    draw = np.random.default_rng(3)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        words[int(draw.integers(0, 200))] = f"new{i}"
        rows.append((1000 - i, " ".join(words)))
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    expected = components({i: shingle_set(t) for i, t in rows}, 85)
    assert {r["doc_id"]: r["component_id"] for r in found} == expected


def test_one_id_with_several_texts(spark):
    """Each text of an id has its own links, and the id ties them together."""
    rows = []
    for k in range(6):
        texts = [" ".join(f"{name}{k}_{i}" for i in range(80)) for name in ("one", "two", "three")]
        at = 100 * k
        rows += [(at + 50 + j, t) for j, t in enumerate(texts)] if k == 5 else [(at + 50, t) for t in texts]
        rows += [(at + 60 + j if k % 2 else at + j, t.replace(f"_{40}", "_other")) for j, t in enumerate(texts)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 80).collect()
    assert len(found) == len(rows)
    for r in found:
        k, i = divmod(r["doc_id"], 100)
        assert r["component_id"] == (500 + 50 + i % 10 if k == 5 else 100 * k + (50 if k % 2 else 0))


def line_set(line):
    line = " ".join(re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), line))).strip(" ")
    return {line[i:i + 8] for i in range(max(len(line) - 7, 1))} if line else set()


def test_line_dedup_equals_brute_force(odd, none):
    docs = {i: t for i, t in ODD if i is not None and t is not None}
    sets = {(i, k): line_set(x) for i, t in docs.items() for k, x in enumerate(t.split("\n"))}
    found = components({k: v for k, v in sets.items()}, 80)
    gone = {k for k, v in sets.items() if v and found[k] != k}
    rows = lines.drop_repeated_lines(odd).select("doc_id", "text", "_clean", "_dropped", *odd.columns[2:]).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        if r["doc_id"] is None or r["text"] is None:
            assert r["_clean"] == r["text"] and r["_dropped"] == 0
            continue
        expected = [x for k, x in enumerate(r["text"].split("\n")) if (r["doc_id"], k) not in gone]
        assert r["_clean"] == "\n".join(expected) or not expected
        assert r["_dropped"] == len(r["text"].split("\n")) - len(expected)
    assert lines.drop_repeated_lines(none).count() == 0


def test_lines_that_repeat_themselves(spark):
    """Separators and chants of several lengths: few shingles, each of them often."""
    draw = np.random.default_rng(5)
    words = [f"{'bcdfgh'[i % 6]}{'aeiou'[i % 5]}lk{i}" for i in range(40)]
    texts = ["-" * 60, "-" * 100, "=" * 9, "=" * 300, "buy now " * 20, "buy now " * 35, "BUY  now " * 3, "ab" * 40, "ab" * 90, "tiny", "-" * 7]
    for i in range(8):
        line = [words[int(k)] for k in draw.integers(0, 40, 12)]
        texts += [" ".join(line), " ".join(line * 2), " ".join(line * (3 + i)) + " end"]
    rows = [(i, "\n".join([f"only in {i} {i * 7919}", t, "x" + t])) for i, t in enumerate(texts)]
    sets = {(i, k): line_set(x) for i, t in rows for k, x in enumerate(t.split("\n"))}
    found = components(sets, 80)
    gone = {k for k in sets if found[k] != k}
    assert (1, 1) in gone and (5, 1) in gone
    plain = {r["doc_id"]: r["gone"] for r in lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(i, k) for i, ks in plain.items() for k in ks} == gone


def test_packing_places_every_id_once(odd, none):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for capacity in (16, 4096):
        rows = packing.pack(odd, path, capacity).collect()
        by_doc = {}
        for r in rows:
            by_doc.setdefault(r["doc_id"], []).append(r)
        for i, t in ODD:
            ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            own = sorted({r["start"]: r for r in by_doc[i]}.values(), key=lambda r: r["start"])
            assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
            for r in own:
                assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())
        assert sum(r["doc_tokens"] for r in rows if r["start"] == 0) == sum(r["length"] for r in rows)
        sequences = {}
        for r in rows:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
    assert packing.pack(none, path).count() == 0


def test_histogram_packing_uses_every_length():
    draw = np.random.default_rng(2)
    for _ in range(50):
        counts = {int(k): int(draw.integers(1, 40)) for k in draw.integers(1, 65, 12)}
        used = {}
        for number, pattern in packing.pack_histogram(counts, 64):
            assert sum(length * times for length, times in pattern) <= 64
            for length, times in pattern:
                used[length] = used.get(length, 0) + number * times
        assert used == counts


def test_search_equals_brute_force(spark):
    draw = np.random.default_rng(4)
    rows = [(i, [float(x) for x in draw.integers(-2, 3, 4)]) for i in range(120)]
    rows += [(200, None), (250, [1.0, None, 0.0, 0.0]), (300, [1.0, float("nan"), 0.0, 0.0]), (None, [1.0] * 4), (350, [1.0, 2.0]), (351, [2.0, 2.0]),
             (0, rows[0][1]), (400, [float("inf")] * 4), (450, []), (500, [1e15, 1e15, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(4)
    found = search.top_k(df, F.col("vec_id") % 50 == 0, 5, candidates=16, queries=3).collect()
    good = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    expected = []
    for q, a in good.items():
        if q % 50 == 0:
            scored = sorted((-max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in good.items() if i != q and len(a) == len(b))
            expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])]
    assert sorted(map(tuple, found)) == sorted(expected)
    assert search.top_k(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("tile", [4, 16, 4096])
def test_search_with_repeated_candidates(spark, tile):
    """Rows of one id take one place, however many of them are among the best."""
    rows = [(0, 1), (1, 90), (1, 90), (2, 80), (3, 70), (4, 60), (5, 50), (6, 40)] + [(7, 30 + i) for i in range(70)] + [(8, 1), (8, 39)]
    df = spark.createDataFrame([(i, [float(x)]) for i, x in rows], "vec_id long, embedding array<double>").coalesce(1)
    best = {i: max(x for j, x in rows if j == i) for i in range(1, 9)}
    for k in (1, 3, 5, 20):
        found = search.top_k(df, F.col("vec_id") == 0, k, candidates=tile)
        expected = sorted((-65536 * x, i) for i, x in best.items())[:k]
        assert [(r["vec_id"], -r["score"]) for r in found.orderBy("rank").collect()] == [(i, s) for s, i in expected]


def test_url_rules(spark):
    urls_ = [None, "", "no scheme", "http://a.ORG/x", "http://example.org/es/1", "https://m.example.org/en/19", "x://org", "x://org/?q", "x://.org/",
             "http://a.com/de/1#f", "http://a.com/fr/1", "http://notexample.org/es/", "http://a.com?u=://b.org/", "http://a.org:80/es/", "http://example.org/es/1"]
    pages = spark.createDataFrame([(k, u, "h", "r", 1) for k, u in enumerate(urls_)], "page_id long, url string, host string, rule string, n int")
    found = {r["page_id"]: r for r in urls.judge(pages, urls.rule_table(spark, URL_RULES)).collect()}
    assert len(found) == len(urls_)
    for k, u in enumerate(urls_):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda x: x.group().lower(), m[1]), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, a) for h, p, a in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, action = max(fit, default=(0, None, "allow"))
        assert (found[k]["host"], found[k]["path"], found[k]["rule"], found[k]["verdict"]) == (host, path, rule, action)
    assert urls.judge(pages.limit(0), urls.rule_table(spark, URL_RULES)).count() == 0
    assert {r["verdict"] for r in urls.judge(pages, urls.rule_table(spark, URL_RULES).limit(0)).collect()} == {"allow"}


def test_rule_counts_equal_a_plain_version(odd, none, labels):
    def plain(text):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows, cover = {}, set()
        for i in range(len(words) - 7):
            windows.setdefault(tuple(words[i:i + 8]), []).append(i)
        for where in windows.values():
            if len(where) > 1:
                cover |= {i + k for i in where for k in range(8)}
        full = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(cover))

    rows = rules.judge(odd, labels).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        counts = plain(r["text"])
        assert tuple(r[c] for c in rules.st.COUNTS) == counts
        assert r["base_failed"] == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0]) and not (r["kept"] and r["base_failed"])
    assert rules.judge(none, labels).count() == 0
    assert rules.judge(odd, labels.limit(0), keep_only=True).columns == odd.columns


def test_classifiers_learn_and_take_odd_rows(labelled, odd, none, labels):
    for judge, label in ((quality.score, "quality"), (toxicity.score, "toxic")):
        found = judge(labelled, labels).join(labels.where(f"{label} is not null").dropDuplicates(["doc_id"]), "doc_id").where(held_out()).collect()
        right = np.mean([r["predicted"] == r[label] for r in found])
        assert len(found) > 40 and right > 0.95
        rows = judge(odd, labels).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
        assert judge(none, labels).count() == 0 and judge(odd, labels.limit(0)).count() == len(ODD)


def test_pair_products_follow_the_identity():
    machine = quality.FactorisationMachine(2)
    draw = np.random.default_rng(6)
    index, value = draw.choice(1000, 9, replace=False), draw.normal(size=9).astype(np.float32)
    margin, _ = machine.margins(np.zeros(9, int), index, value, 1)
    v = machine.vectors[index]
    pairs = sum(float(v[i] @ v[j]) * value[i] * value[j] for i in range(9) for j in range(i))
    assert abs(margin[0] - pairs) < 1e-5


def test_harmless_phrases_take_an_entry_back():
    lexicon = toxicity.Lexicon()
    automaton = lexicon.automaton()
    folded = lambda t: toxicity.fold(t, lexicon.folding)
    assert lexicon.measure(folded("put it in the trash can now"), automaton) == (0.0, 0.0)
    for text in ("what trash", "ТRАSH!", "tr4$h", "tra​sh", "TRÁSH"):
        assert lexicon.measure(folded(text), automaton)[0] > 0, text


def test_language_code_lengths_equal_a_plain_version(labelled, odd, none):
    texts = {"a": ["the cat and the hat", "the bat"], "b": ["der hund und die katze", "das ist"]}
    model = language.PartialMatching(texts, 2)

    def bits(text, lang):
        count = {}
        for t in texts[lang]:
            raw = t.encode()
            for k in range(3):
                for i in range(k, len(raw)):
                    count.setdefault(raw[i - k:i], {}).setdefault(raw[i], 0)
                    count[raw[i - k:i]][raw[i]] += 1
        total, raw = 0.0, text.lower().encode()
        for i in range(len(raw)):
            for k in range(min(2, i), -1, -1):
                seen = count.get(raw[i - k:i])
                if seen:
                    n, d = sum(seen.values()), len(seen)
                    if raw[i] in seen:
                        total += np.log2((n + d) / seen[raw[i]])
                        break
                    total += np.log2((n + d) / d)
            else:
                total += 8
        return total

    for text in ("the hat", "die katze", "zebra", "x"):
        raw = np.frombuffer(text.encode(), np.uint8)
        got = model.bits(raw, np.array([0, len(raw)]))[0]
        assert np.allclose(got, [bits(text, "a"), bits(text, "b")], atol=1e-3)
    rows = language.identify(odd).collect()
    assert len(rows) == len(ODD)
    assert all((r["lang_pred"] == "und") == (r["text"] is None or not any(c.isalpha() for c in r["text"])) for r in rows)
    assert language.identify(none).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_outlines_never_exceed_what_sets_differ_in(spark):
    draw = np.random.default_rng(5)
    base = draw.integers(0, 2**64, 120, dtype=np.uint64)
    sets = {i: np.unique(np.concatenate([base[draw.random(120) > 0.1], draw.integers(0, 2**64, 6, dtype=np.uint64)])) for i in range(30)}
    # Members that agree in the 32 bits by which they are told apart.
    sets[30] = np.unique(np.append(sets[0], sets[0][:20] ^ np.uint64(1)))
    df = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "id long, content binary")
    found = {r["id"]: r for r in similar.outlines(df, minhash._expand, 4).collect()}
    assert set(found) == set(sets)
    exact = 0
    for a in sets:
        for b in range(a):
            marks = sum(((found[a][f"mark_{k}"] ^ found[b][f"mark_{k}"]) & (2**64 - 1)).bit_count() for k in range(4))
            bound, differ = found[a]["alone"] + found[b]["alone"] + marks, len(np.setxor1d(sets[a], sets[b]))
            assert bound <= differ
            exact += bound >= 0.8 * differ
    assert exact > 300
