"""Operator 5 against plain Python, operator 2 against greedy segmentation."""

import random
import re
from collections import defaultdict

import public_tokenizers

from creditspark.llm import urlfilter as uf
from creditspark.llm import wordpiece as wp
from creditspark.llm.catalogue import QUERIES

PAGE = "page_id long, url string, template string, n int"
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
         ("block", "com", "/de/")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    best = None
    for kind, h, p in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (kind, h + p)
    return best


def brute(pages, bad_of):
    """The whole method in plain Python."""
    rows = []
    for page, url in pages:
        host, path = split(url)
        rows.append([page, host, path, [x for x in path.split("/") if x], []])
    shape = lambda s: re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]+", "0", s))
    level = 0
    while True:
        going = [r for r in rows if len(r[3]) > level and len(r[4]) == level]
        if level >= uf.LEVELS:  # below, nodes with good and bad labels only
            kinds = defaultdict(set)
            for r in going:
                kinds[r[1], tuple(r[4])].add(bad_of.get(r[0]))
            going = [r for r in going if {0, 1} <= kinds[r[1], tuple(r[4])]]
        if not going:
            break
        seen = defaultdict(lambda: defaultdict(int))
        for r in going:
            seen[r[1], tuple(r[4]), shape(r[3][level])][r[3][level]] += 1
        for r in going:
            s = shape(r[3][level])
            v = seen[r[1], tuple(r[4]), s]
            share = len(v) / sum(v.values())
            wild = len(v) >= uf.WILD_VALUES and share >= uf.WILD_SHARE or "0" in s and len(v) >= 2 and share >= uf.WILD_DIGITS_SHARE
            r.append("{" + s + "}" if wild else r[3][level])
        for r in going:
            r[4] = [*r[4], r.pop()]
        level += 1
    for r in rows:
        r[4] = tuple(r[4]) + (("{*}",) if len(r[3]) > len(r[4]) else ())
    leaf = defaultdict(lambda: [0, 0])
    for r in rows:
        s = leaf[r[1], r[4]]
        if r[0] in bad_of:
            s[0] += 1
            s[1] += bad_of[r[0]]

    def whole(host, node):
        """(whole?, labelled, bad) of the subtree."""
        own = [t for h, t in leaf if h == host and t[: len(node)] == node]
        children = {t[: len(node) + 1] for t in own}
        parts = [(True, *leaf[host, node])] if node in own else []
        parts += [whole(host, c) for c in sorted(children) if c != node]
        n, b = sum(p[1] for p in parts), sum(p[2] for p in parts)
        used = [p for p in parts if p[1]]
        same = True
        if len(used) > 1 and 0 < b < n:
            p, df = b / n, len(used) - 1
            chi = (sum(x[2] ** 2 / x[1] for x in used) - b * p) / (p * (1 - p))
            same = chi <= df * (1 - 2 / (9 * df) + uf.APART_Z * (2 / (9 * df)) ** 0.5) ** 3
        return all(p[0] for p in parts) and same, n, b

    branch = {}
    for host, t in leaf:
        branch[host, t] = next((t[:k] for k in range(len(t)) if whole(host, t[:k])[0]), t)
    sums = defaultdict(lambda: [0, 0])
    for k, (n, b) in leaf.items():
        s = sums[k[0], branch[k]]
        s[0] += n
        s[1] += b
    n, b = (sum(x[k] for x in leaf.values()) for k in (0, 1))
    share = b / n if n else 0.0
    out = []
    for page, host, path, _, t in rows:
        m, c = sums[host, branch[host, t]]
        p = (c + uf.PRIOR_PAGES * share) / (m + uf.PRIOR_PAGES)
        sure = p - uf.SURE_Z * (p * (1 - p) / (m + uf.PRIOR_PAGES)) ** 0.5
        own = "block" if sure > min(uf.LIFT * share, (1 + share) / 2) else "allow"
        rule = rule_of(host, path)
        out.append((page, host, path, rule[1] if rule else None, rule[0] if rule else own, "/" + "/".join(t)))
    return sorted(out, key=repr)


def test_url_parts_and_rules(spark):
    urls = [None, "", "example.org/es/1", "http://", "HTTP://Example.ORG/es/1?x#y", "https://a.b.example.org/en/12", "http://org",
            "http://org/", "x://com/fr/é?/de/", "http://xcom/de/", "http://a.com:80/de/", "http://u@b.com/de/?q", "http://a.net?x=://b.org/",
            "http://a.org#/es/", "a://b://c.org/d", "http://ÉXAMPLE.com/de/1", "http://example.org/en/", "http://example.org//es/",
            "http://a.net/" + "seg/" * 5000, "http://h.net/1/2/3/4/5/6", "http://h.net/1/2/3/4/5/7", "http://example.org/en/1"]
    pages = list(enumerate(urls)) + [(3, "http://dup.net/a"), (3, "http://dup.net/b"), (None, "http://h.net/zz")]
    df = spark.createDataFrame([(p, u, "", None) for p, u in pages], PAGE)
    none = spark.createDataFrame([], "page_id long, bad int")
    assert sorted(map(tuple, uf.judge(df, none).collect()), key=repr) == brute(pages, {})
    assert uf.judge(spark.createDataFrame([], PAGE), none).collect() == []


def test_branches_equal_plain_python(spark):
    rng = random.Random(8)
    pages, bad = [], {}
    for i in range(1500):
        host = rng.choice(["a.net", "a.net", "a.net", "b.net", "c.example.com", f"h{i % 40}.net"])
        section = rng.choice(["news", "ads", "forum", "x"])
        path = rng.choice([f"/{section}/{rng.randint(1, 500)}", f"/{section}/{rng.choice('pqr')}/{rng.randint(1, 9)}.html",
                           f"/{section}/", f"/tag-{rng.randint(1, 60)}/a/b/c/d/e"])
        pages.append((i, f"http://{host}{path}"))
        if rng.random() < 0.6:
            bad[i] = int(rng.random() < (0.9 if section == "ads" and host == "a.net" else 0.1))
    df = spark.createDataFrame([(p, u, "", 0) for p, u in pages], PAGE)
    labels = spark.createDataFrame(list(bad.items()), "page_id long, bad int")
    got = sorted(map(tuple, uf.judge(df, labels).collect()), key=repr)
    assert got == brute(pages, bad)
    assert {g[4] for g in got if g[1] == "a.net" and g[2].startswith("/ads/") and re.search(r"\d", g[2])} == {"block"}
    assert {g[4] for g in got if g[2].startswith("/news/")} == {"allow"}


def test_deep_sections_are_told_apart(spark):
    """Sections that differ from the seventh segment on, below long common paths."""
    rng = random.Random(12)
    pages, bad = [], {}
    for i in range(900):
        section = rng.choice(["good", "spam", "mixed"])
        deep = "/".join(["a", "b", "c", "d", "e", "f"] * (40 if i % 2 else 1))
        pages.append((i, f"http://{'x' if i % 2 else 'y'}.net/{deep}/{section}/{rng.randint(1, 9999)}"))
        if rng.random() < 0.5:
            bad[i] = int(rng.random() < {"good": 0.05, "spam": 0.9, "mixed": 0.15}[section])
    df = spark.createDataFrame([(p, u, "", 0) for p, u in pages], PAGE)
    got = sorted(map(tuple, uf.judge(df, spark.createDataFrame(list(bad.items()), "page_id long, bad int")).collect()), key=repr)
    assert got == brute(pages, bad)
    assert {g[4] for g in got if "/spam/" in g[2]} == {"block"} and {g[4] for g in got if "/good/" in g[2]} == {"allow"}
    assert all("{*}" not in g[5] for g in got if "/spam/" in g[2])


def test_planted_section_in_the_pages_table(spark):
    """A section whose pages are mostly bad is blocked, the table's own pages stay as they were."""
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    labels = uf.page_labels(pages, spark.read.parquet(f"{sf}/labels.parquet"))
    before = {r.page_id: r.verdict for r in uf.judge(pages, labels).collect()}
    planted = [(10_000 + i, f"http://news.info/promo/deal-{i}") for i in range(40)] + [(20_000 + i, f"http://news.info/local/story-{i}") for i in range(40)]
    marks = [(10_000 + i, int(i % 10 > 0)) for i in range(30)] + [(20_000 + i, int(i % 10 == 0)) for i in range(30)]
    both = pages.unionByName(spark.createDataFrame(planted, "page_id long, url string"))
    after = {r.page_id: r.verdict for r in uf.judge(both, labels.unionByName(spark.createDataFrame(marks, "page_id long, bad int"))).collect()}
    assert {after[p] for p, _ in planted[:40]} == {"block"} and {after[p] for p, _ in planted[40:]} == {"allow"}
    assert sum(after[p] != v for p, v in before.items()) <= 0.01 * len(before)


def test_few_bad_labels_say_little():
    assert abs(uf.limit_of(0.15) - 0.225) < 1e-12 and uf.limit_of(0.9) == 0.95 and uf.limit_of(0.0) == 0.0


def test_whole_pages_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    bad = {}
    for p, u in pages:
        m = re.search(r"/([0-9]{1,18})[^/0-9]*/?$", split(u)[1])
        if m and int(m[1]) in quality:
            bad[p] = 1 - quality[int(m[1])]
    assert len(bad) > 50
    assert sorted(map(tuple, QUERIES["op5_url_filter"](spark, sf).collect()), key=repr) == brute(pages, bad)


def greedy(word, first, later):
    n, at = 0, 0
    while at < len(word):
        pieces = first if at == 0 else later
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return wp.UNKNOWN
        n, at = n + 1, end
    return n


def test_automaton_equals_greedy_search():
    rng = random.Random(6)
    for _ in range(60):
        make = lambda k: {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(k)}
        first, later = make(rng.randint(1, 12)), make(rng.randint(0, 12))
        machine = wp.Automaton(first, later)
        for _ in range(300):
            word = "".join(rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 14)))
            assert machine.pieces(word) == greedy(word, first, later), (word, first, later)


def full_greedy(word, pieces):
    """Greedy search over the whole piece list, the word mark being part of the word."""
    n, at, text = 0, 0, "\u2581" + word
    while at < len(text):
        end = next((e for e in range(min(len(text), at + 48), at, -1)
                    if text[at:e] in pieces and (at == 0 or text[at] != "\u2581")), None)
        n, at = (n + 1, end) if end else (n + len(text[at].encode()), at + 1)
    return n


def piece_list(path):
    """All plain pieces, read without the operator's own reader."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    assert sum(model.is_byte(k) for k in range(len(names))) == 256 and max(map(len, names)) <= 48
    return {p for k, p in enumerate(names) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))}


def test_counts_over_documents(spark, monkeypatch):
    monkeypatch.setattr(wp, "MEMORY_WORDS", 5000)
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = piece_list(path)
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op2_token_counts"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = [full_greedy(w, pieces) for w in re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id])]
        assert (r.n_words, r.n_tokens, r.n_unknown, r.longest_word_tokens) == (len(n), sum(n), 0, max(n, default=0))
    odd = [(None, None, 1), (1, "", 2), (1, "a  b\n", 3), (2, "x" * 200_000, 4), (3, "\u0001\U0001F600 the", 5)]
    df = spark.createDataFrame(odd, "doc_id long, text string, n_words int")
    got = sorted(map(tuple, wp.token_counts(df, path).collect()), key=repr)
    want = []
    for d, t, _ in odd:
        n = [full_greedy(w, pieces) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        want.append((d, len(n), sum(n), 0, max(n, default=0)))
    assert got == sorted(want, key=repr)
    none = df.limit(0)
    assert wp.token_counts(none, path).collect() == []


def test_mark_alone_and_byte_pieces(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = piece_list(path)
    machine = wp.automaton(path)
    odd = ["12345", "\u00f1and\u00fa", "\u00e7a", "\u00eatre", "\u6f22\u5b57", "\u6f22" * 50, "\U0001F600x\u0001", "7" * 200_000, "\u2581", "a\u2581b", "\uffff",
           "x\U00012000\U00012001y", "the1the"]
    rng = random.Random(1)
    letters = "abthe129\u00f1\u00e7\u00ea\u6f22\u5b57\U0001F600\u0001\u00ff\u0431\U00012000-."
    odd += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    assert [(w, machine.pieces(w)) for w in odd] == [(w, full_greedy(w, pieces)) for w in odd]
    assert machine.pieces("12345") == 6 and machine.pieces("7" * 200_000) == 200_001
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in wp.token_counts(docs, path).collect()}
    for r in docs.collect():
        n = [full_greedy(w, pieces) for w in re.findall(r"[^\x20\x09-\x0D]+", r.text)]
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_unknown, got[r.doc_id].longest_word_tokens) == (sum(n), 0, max(n, default=0))


def test_automaton_without_byte_pieces_or_mark():
    assert wp.Automaton(["", "ab"], ["c", "d"]).pieces("cd") == 3
    assert wp.Automaton(["", "ab"], ["c", "d"]).pieces("ax") == wp.UNKNOWN
    assert wp.Automaton(["ab"], ["c"], True).pieces("ac") == 3 + 1 + 1
