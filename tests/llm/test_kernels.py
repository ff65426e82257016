"""The operators' inner parts against brute force."""

import base64
import io
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gridrecon.llm import bpe, hnsw, html, langid, simhash, topk, toxicity, warc

RANKS = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
TOK = bpe.Tokenizer(RANKS)
ENC = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 's're'vell'd \n\t12é²中　\x1c\x85'!?.😀Ⅷ"), max_size=60), min_size=1, max_size=5))
def test_bpe_is_the_library(texts):
    for t, (ids, at) in zip(texts, TOK.encode(texts)):
        assert ids.tolist() == ENC.encode_ordinary(t)
        assert TOK.decode(ids) == t.encode() and at[-1] == len(t)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, " " * 300, "'" * 200 + "s" * 300, "", "x's't'll''ve"])
def test_bpe_long_pieces(text):
    ids, _ = next(TOK.encode([text]))
    assert ids.tolist() == ENC.encode_ordinary(text)


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("text", ["", " \n", "One", "one TWO", "a b c d e f", "É é É b", "x " * 1000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == 0


@pytest.mark.parametrize("n", [1, 2, 40, 900])
def test_gray_tree_finds_all_pairs(n):
    rng = random.Random(n)
    base = rng.getrandbits(64)
    f = np.unique(np.array([base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(9)) ^ (1 << rng.randrange(64)) if i % 3 else rng.getrandbits(64) for i in range(n)], np.uint64))
    f = f[np.argsort(simhash.gray_rank(f))]
    got = {(a, b) for i, j in simhash.GrayTree(f).pairs(f, 2) for a, b in zip(i.tolist(), j.tolist())}
    d = np.bitwise_count(f[:, None] ^ f[None]) <= 2
    assert got == {(a, b) for a, b in zip(*np.nonzero(d)) if a < b}
    # an upper tree over groups of 7: every partner's group is among those found
    starts = np.arange(0, len(f), 7)
    upper = simhash.GrayTree(np.bitwise_and.reduceat(f, starts), np.bitwise_or.reduceat(f, starts))
    sent = set(zip(*(x.tolist() for x in upper.search(f, 2))))
    assert {(a, b // 7) for a, b in zip(*np.nonzero(d))} <= sent


@pytest.mark.parametrize("table", [html.TABLE, 4])
def test_longest_common_subsequence(monkeypatch, table):
    monkeypatch.setattr(html, "TABLE", table)
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got, it = html.common(a, b), iter(b)
        assert len(got) == best[-1][-1] and all(a[k] in it for k in got)


def test_page_structure():
    page = """<html><head><title>t</title><script>var a="</p>";</script></head><body><header>top</header><nav><li>x<li>y</nav>
    <div class="cookie-notice">c</div><article><h1>A &amp; B</h1><p>one<b>two</b>  three<br>four<p>five<aside>no</aside><div class="comments">c1</div><form>f</form></article>
    <footer>&copy;</footer><p hidden>h</p></body>"""
    got, found = html.lines(page)
    assert found and " ".join(t for t, inside, gone in got if inside and not gone) == "A & B onetwo three four five"
    assert html.lines(None) == ([], False) and html.lines("<p>a &am")[0] == [("a &am", False, False)]


@pytest.mark.parametrize("page, want", [
    ("<p>one</p><a title=don't>link</a><p>it's</p><p>two</p>", ["one", "link", "it's", "two"]),
    ('<p>x</p><a title="y>z</a>', ["x", "z"]),
    ("<p a='1>2' b=\"c>d\" =e f= >t</p>", ["t"]),
    ("<article><p class='lead alert'>a</p><math><mi>b</mi></math><noscript>c</noscript><object>d</object></article>", ["a", "b", "c", "d"]),
    ("<article><p class=ad>a</p><p data-class='ad'>b</p></article>", ["b"]),
    ("<p>5 < 6 & 7 &gt; 2</p>", ["5 < 6 & 7 > 2"]),
])
def test_loose_markup(page, want):
    assert [t for t, _, gone in html.lines(page)[0] if not gone] == want


def test_automaton_holds_all_substrings():
    rng = random.Random(2)
    s = [rng.randrange(3) for _ in range(60)]
    t = langid.automaton(s)
    subs = {tuple(s[i:j]) for i in range(60) for j in range(i + 1, 61)}
    for _ in range(500):
        x = [rng.randrange(3) for _ in range(rng.randrange(1, 7))]
        at = 0
        for c in x:
            at = t[at].get(c, 0)
            if not at:
                break
        assert bool(at) == (tuple(x) in subs)


@pytest.mark.parametrize("dense", [langid.DENSE, 2000])
def test_phrases_against_plain_parsing(monkeypatch, dense):
    """Whole texts, however long, are one parse: also texts of many pieces, of one letter, of more letters than a dense table holds."""
    monkeypatch.setattr(langid, "PIECE", 16)
    monkeypatch.setattr(langid, "DENSE", dense)
    rng = random.Random(1)
    kanji = "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(3000))
    sample = {"a": "the cat and the dog sat " * 3, "b": "der hund und die katze " * 3, "c": kanji}
    p = langid.Parser(sample)
    texts = ["the dog and a katze", "x", "", None, "Der  Hund!", "the cat " * 200, "t" * 700, "ab" * 500, kanji[500:900] + kanji[100:300] + "\U00032100", "".join(rng.choice("the dcasoundrki ") for _ in range(3000))]
    bits, letters = p.phrases(texts)
    assert letters.tolist() == [True, True, False, False] + [True] * 6
    for i, t in enumerate(texts):
        codes, _ = p.codes(t or "")
        codes = "".join(map(chr, codes))
        for k, lang in enumerate(p.langs):
            train, count, j = "".join(map(chr, p.codes(sample[lang])[0])), 0, 0
            while j < len(codes):
                n = 1
                while j + n < len(codes) and codes[j : j + n + 1] in train:
                    n += 1
                j, count = j + n, count + 1
            assert bits[i, k] == pytest.approx(count * np.log2(len(train)) / max(1, len(codes)))


@pytest.mark.parametrize("scale", [1, 2**26])
def test_top_k_of_a_bucket(scale):
    rng = np.random.default_rng(3)
    c = rng.integers(-9, 9, (1500, 6)) * scale
    c[700:] = c[0]
    ids = rng.permutation(1500)
    i, who, s = topk.best_of_bucket(c[:20], c, ids, ids[:20], 5)
    p = c[:20].astype(object) @ c.T.astype(object)
    for q in range(20):
        want = sorted(((-p[q, j], ids[j]) for j in range(1500) if ids[j] != ids[q]))[:5]
        assert [(-int(a), b) for a, b in zip(s[i == q], who[i == q])] == want


def test_hnsw_recall():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(900, 16)), rng.normal(size=(1, 16)) + rng.normal(0, 0.05, (300, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph.build(x.astype(np.float32))
    g = hnsw.Graph.load(x.astype(np.float32), np.load(io.BytesIO(g.dump(nodes=np.arange(1200)))))
    true, found = (x @ x.T) >= 0.9, np.zeros((1200, 1200), bool)
    for i, j in hnsw.links_of(g, x, x, 0.9):
        found[i, j] = True
    assert not (found & ~true).any() and found.sum() >= 0.99 * true.sum()


def test_hnsw_recall_of_rare_links():
    """Pairs planted among unrelated vectors: most queries have no link but themselves."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 32))
    x[5900:] = x[:100] + rng.normal(0, 0.2, (100, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph.build(x.astype(np.float32))
    true, found = (x @ x.T) >= 0.9, np.zeros((6000, 6000), bool)
    for i, j in hnsw.links_of(g, x, x, 0.9):
        found[i, j] = True
    assert not (found & ~true).any() and 150 < true.sum() - 6000
    assert (found.sum() - 6000) >= 0.97 * (true.sum() - 6000)


def test_toxicity_scores_against_plain_loops():
    """Convolutions, pooling, output and threshold, word by word, for short, empty and long texts."""
    rng = np.random.default_rng(2)
    m = toxicity.Model()
    texts = ["you are bad bad words", "nice calm day today", "bad", "calm", "so bad a day", "a calm nice thing"]
    for _ in range(2):
        m.fit([toxicity.buckets(t) for t in texts], np.array([1, 0, 1, 0, 1, 0]))
    m.langs, m.common, m.thresholds, m.threshold = ["x", "y"], {"calm": 0, "bad": 1}, np.array([0.3, 0.7]), 0.5
    scorer = toxicity.Scorer(m)
    scorer.SPAN = 8
    for t in [*texts, "", None, " ".join(rng.choice(["bad", "calm", "day", "zzz"], 100))]:
        words = toxicity.WORD.findall((t or "").lower())
        e = [sum(m.emb[h] for h in toxicity.hashes(w)) for w in words] + [3 * m.emb[0]] * (max(toxicity.WIDTHS) - len(words))
        z = m.shift
        for w, (k, c) in enumerate(zip(toxicity.WIDTHS, m.conv)):
            for f in range(toxicity.FILTERS):
                best = max(sum(float(e[a + j] @ c[j][:, f]) for j in range(k)) for a in range(len(e) - k + 1))
                z += max(0.0, best + m.bias[w * toxicity.FILTERS + f]) * m.out[w * toxicity.FILTERS + f]
        p, votes = 1 / (1 + np.exp(-z)), [m.common[w] for w in words if w in m.common]
        cut = m.thresholds[max(set(votes), key=lambda k: (votes.count(k), -k))] if votes else 0.5
        want = 0.5 * p / cut if p < cut else 0.5 + 0.5 * (p - cut) / (1 - cut)
        assert scorer.score(t) == pytest.approx(want, abs=1e-4)


def test_warc_record():
    r = warc.parse(warc.record(7, "http://www.Example.com/a b?x=1#f", "é".encode(), None))
    assert (r["page_id"], r["payload_bytes"], r["record_type"], r["payload"]) == (7, 2, "response", "é".encode())
    r = warc.parse(warc.record(3, None, b"abc", 7))
    assert (r["record_type"], r["refers_to"], r["payload_bytes"], r["payload"]) == ("revisit", 7, 3, b"")
    assert warc.surt("http://www.Example.com:80/a?b#c") == "com,example)/a?b" and warc.surt(None) == ")/"
