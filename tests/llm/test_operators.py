"""The corpus operators against brute force on small fixtures, odd inputs, and their SQL."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from settlegrid.llm import (decontaminate, exact_dedup, license_scan, line_dedup, packing, queries, quality, sharding,
                            toxicity, url_filter)
from settlegrid.llm.common import connected_components
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    """Documents with columns whose names clash with those of results."""
    return spark.createDataFrame([(*r, "en", 7, True) for r in rows], "doc_id long, text string, shard string, score long, kept boolean")


ODD = [(1, None), (2, ""), (3, " \t\n"), (3, " \t\n"), (None, "x y z"), (None, None), (4, "word " * 60_000), (5, "é ü \n\n A")]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    ok, message = compare(spark, name, queries.Q[name], queries.SQL[name], SF, connect(SF))
    assert ok, message


def test_exact_groups(spark):
    rows = ODD + [(7, "a  b"), (6, "a\tb"), (6, "a b"), (8, "A b"), (9, "a b ")]
    got = exact_dedup.exact_groups(docs_of(spark, rows)).collect()
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub("[\x20\x09-\x0D]+", " ", text or "")].append(doc)
    want = Counter()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.exact_dedup(docs_of(spark, rows))
    assert kept.count() == len(groups) and kept.columns == ["doc_id", "text", "shard", "score", "kept"]
    assert exact_dedup.exact_groups(docs_of(spark, rows).limit(0)).count() == 0


def test_cuckoo_index_against_a_dict():
    r, index, live = random.Random(3), exact_dedup.CuckooIndex(2, 10), {}
    keys = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(3000)]
    for step in range(12_000):
        key = r.choice(keys)
        if key in live and r.random() < 0.5:
            assert index.delete(key)
            del live[key]
        elif key not in live:
            index.insert(key, step)
            live[key] = step
    assert dict(index.entries()) == live and index.live == len(live)
    assert all((index.find(k) is not None) == (k in live) for k in keys)
    twin = bytearray(keys[0])
    twin[-1] ^= 1  # same fingerprint and buckets, other content
    assert index.find(bytes(twin)) is None and not index.delete(bytes(twin))


def test_live_digests_come_and_go(spark):
    def rows(*keys):
        return spark.createDataFrame([(bytes([k]) * 32,) for k in keys], "digest binary")
    index = rows(1, 1, 2).groupBy("digest").count().withColumnRenamed("count", "size")
    got = exact_dedup.update_index(index, rows(3, 3, 2), rows(1, 1, 3))
    assert {r.digest[0]: r["size"] for r in got.collect()} == {2: 2, 3: 1}


def test_line_dedup(spark):
    r = random.Random(1)
    pool = ["x" * 39, "Y" * 40, " " + "y" * 40 + "\t", "é" * 40, "long line number %s " % ("z" * 30)] + ["once %d " % i + "q" * 50 for i in range(40)]
    rows = [(d, "\n".join(r.choice(pool) for _ in range(r.randint(1, 12)))) for d in range(20, 80)]
    rows += [(d, "Y" * 40 + "\n" + "other") for d in range(100, 400)] + ODD
    got = {(x.doc_id, x.kept_text): x for x in line_dedup.line_dedup(docs_of(spark, rows), with_text=True).collect()}
    holders = defaultdict(set)

    def key(line):
        return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 40:
                holders[key(line)].add(doc)
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(holders[key(x)]) < 5 or doc == max(holders[key(x)])]
        x = got[(doc, "\n".join(kept))]
        assert (x.n_lines, x.n_dropped) == (len(lines), len(lines) - len(kept))
        assert x.kept_sha256 == hashlib.sha256("\n".join(kept).encode()).hexdigest()


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    import public_tokenizers
    r = random.Random(2)
    words = ["the", "Straße", "naïve", "123", "###", "<|endoftext|>", " ", "日本", "\n\n", "don't"]
    rows = ODD + [(d, " ".join(r.choice(words) for _ in range(r.randint(0, 3000)))) for d in range(20, 60)]
    got = packing.pack_documents(docs_of(spark, rows)).collect()
    judge, whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for doc, text in rows:
        ids = judge.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        start = 0
        for piece, stop in enumerate(range(first, len(ids) + 1, 2048)):
            crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[start:stop]))
            whole[(doc, piece, start, stop - start, crc)] += 1
            start = stop
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == whole
    bins = defaultdict(list)
    for x in got:
        bins[x.sequence_id].append((x.offset, x.length))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 2048
    assert len(bins) <= -(-sum(x.length for x in got) // 2048) + 2
    assert packing.pack_documents(docs_of(spark, rows).limit(0)).count() == 0


def test_local_search_empties_bins_and_keeps_limits():
    r = random.Random(4)
    for _ in range(10):
        lengths = [r.randint(1, 100) for _ in range(400)]
        first, made = packing.best_fit(lengths, 100)
        worse = list(range(400))  # one bin each: the search alone has to do the work
        for start in (first, worse):
            home = packing.improve(lengths, start, 100)
            fill = Counter()
            for b, n in zip(home.tolist(), lengths):
                fill[b] += n
            assert max(fill.values()) <= 100 and len(fill) <= len(set(start))
        assert len(fill) <= made + 8


def test_licenses_against_plain_search(spark):
    mit = license_scan.TEMPLATES[0][2]
    texts = ["MIT License. mit-license, (MIT) license", "CC-BY cc by", "the GNU General Public License and Apache License", "permit license", mit.upper(),
             "a b " + mit.replace("charge", "charges"), "x " * 50 + mit.replace("obtaining a copy", "who gets one"), None, "", "é mit  license"]
    rows = list(enumerate(texts, 100)) + ODD[4:]
    got = license_scan.scan_licenses(docs_of(spark, rows)).collect()
    for x, (doc, text) in zip(sorted(got, key=lambda x: str(x.doc_id)), sorted(rows, key=lambda p: str(p[0]))):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        at = [(i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
        if doc is not None:
            assert (x.doc_id, x.n_words, x.n_base) == (doc, len(words), len(at))
            assert (x.first_word, x.last_word) == (min(at)[0] if at else None, max(at)[0] if at else None)
            assert x.base_labels == ",".join(sorted({k for _, k in at})) and 0 <= x.score <= 1
    by = {x.doc_id: x for x in got}
    assert by[104].labels == "mit" and by[104].base_labels == "" and by[104].score == 1.0
    assert by[105].labels == "" and by[106].labels == "mit" and 0.6 <= by[106].score < 1
    assert license_scan.scan_licenses(docs_of(spark, rows).limit(0)).count() == 0


def plain_notice_scores(words, frequency, rare=6, agree=3, drift=3):
    """[(label, score)] of every notice, each start tried."""
    out = []
    for label, key, notice in license_scan.TEMPLATES:
        t, k = notice.split(), key.split()
        key_at = next(i for i in range(len(t)) if t[i:i + len(k)] == k)
        rarest = sorted(set(t), key=lambda w: (frequency[w], w))
        chosen, best = [w for w in rarest if w in words][:rare], 0.0
        for o in {i - p for i, w in enumerate(words) if w in chosen for p, x in enumerate(t) if x == w}:
            placed = [w for p, w in enumerate(t) if w in words[max(o + p - drift, 0):max(o + p + drift + 1, 0)]]
            key_stands = any(words[at:at + len(k)] == k for at in range(max(o + key_at - drift, 0), max(o + key_at + drift + 1, 0)))
            if key_stands and len(set(placed) & set(chosen)) >= min(agree, len(rarest)):
                best = max(best, len(placed) / len(t))
        out.append((label, best))
    return out


def test_license_notices_against_every_start(spark):
    r, texts = random.Random(5), []
    noise = ["lorem", "the", "software", "license", "of", "x1", "permission", "public"]
    for _ in range(120):
        words = []
        for _, _, notice in r.sample(license_scan.TEMPLATES, r.choice([0, 1, 1, 2])):
            words += r.choices(noise, k=r.randint(0, 25))
            for w in notice.split():
                words += r.choices(noise, k=r.choice([0] * 14 + [1, 2])) + ([w] if r.random() < 0.95 else [])
        texts.append(" ".join(words + r.choices(noise, k=r.randint(0, 9))))
    texts += [n for _, _, n in license_scan.TEMPLATES] + ["mit license " * 4_000]
    rows = list(enumerate(texts))
    docs = docs_of(spark, rows)
    frequency, count = license_scan.document_frequency(docs)
    assert count == len(rows)
    got, partial = {x.doc_id: x for x in license_scan.scan_licenses(docs).collect()}, 0
    for doc, text in rows[:-1]:
        scores, base = plain_notice_scores(text.split(), frequency), got[doc].base_labels
        labels = {label for label, x in scores if x >= 0.6} | set(base.split(",") if base else [])
        assert got[doc].labels == ",".join(sorted(labels))
        assert got[doc].score == (1.0 if base else max(x for _, x in scores))
        partial += 0 < got[doc].score < 1
    assert partial > 10 and got[len(rows) - 1].labels == "mit" and got[len(rows) - 1].n_base == 4_000


def test_shards_are_even_whole_and_gapless(spark):
    r = random.Random(6)
    rows = [(d, "same text " * 30 if d % 3 == 0 else "t" * r.randint(0, 900)) for d in range(3000)] + [(None, None), (1, None), (1, None)]
    got = sharding.shard(docs_of(spark, rows), 40).collect()
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in got) == Counter(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    size, slots = Counter(), defaultdict(list)
    for x in got:
        size[x.shard] += x.size
        slots[x.shard].append(x.slot)
    mean = sum(size.values()) / 40
    assert set(size) == set(range(40)) and max(size.values()) < mean + 1800 and min(size.values()) > mean - 1800
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({x.shard for x in got if x.text_crc32 == zlib.crc32(("same text " * 30).encode())}) < 25
    assert sharding.shard(docs_of(spark, rows).limit(0), 40).count() == 0


def test_contamination_in_blocks_and_spans(spark):
    r = random.Random(8)
    words = ["w%d" % i for i in range(50)] + ["É", "x-y"]
    bench = [(i, " ".join(r.choice(words) for _ in range(r.choice([3, 9, 10, 11, 25])))) for i in range(30)] + [(90, None), (91, " .. "), (None, "w1 w2")]
    rows = [(d, (", " if d % 2 else "\n").join([r.choice(words) for _ in range(80)] + bench[d % 30][1].upper().split() + ["end"])) for d in range(40)] + ODD
    docs, items = docs_of(spark, rows), spark.createDataFrame(bench, "item_id long, text string")

    def split(text):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    wins = {(i, tuple(split(t)[k:k + 10])) for i, t in bench if i is not None and split(t) for k in range(max(1, len(split(t)) - 9))}
    want = Counter()
    for doc, text in rows:
        w, hit, ids = split(text), set(), set()
        for i, win in wins if len(w) < 1000 else ():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    ids.add(str(i))
        want[(doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest())] += 1
    for size in (4_000_000, 600):
        got = decontaminate.contamination(docs, items, block_bytes=size).collect()
        assert Counter(tuple(x)[:5] for x in got) == want
    spans = decontaminate.scan_documents(docs, items, keep=("doc_id", "text")).where("n_hit > 0").collect()
    assert all(sum(len(split(x.text[s.start:s.stop])) for s in x.spans) == x.n_hit for x in spans)
    clean = decontaminate.clean_documents(docs, items)
    assert clean.columns == docs.columns and clean.count() == sum(n for k, n in want.items() if not k[2])
    named = docs.toDF("doc_id", "text", "n_hit", "n_words", "spans")
    assert decontaminate.clean_documents(named, items).columns == named.columns
    assert decontaminate.clean_documents(named, items).exceptAll(clean.toDF(*named.columns)).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0


@pytest.mark.parametrize("op,column", [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_classifiers_on_held_out_rows_and_odd_inputs(spark, op, column):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = op(docs, labels).where("held_out").join(labels, "doc_id").select("score", column).toPandas()
    good, bad = held.score[held[column] == 1], held.score[held[column] == 0]
    wins = sum((g > bad).sum() + 0.5 * (g == bad).sum() for g in good) / (len(good) * len(bad))
    assert len(held) > 500 and wins > (0.98 if column == "quality" else 0.93)
    odd = op(docs_of(spark, ODD), labels.limit(0).union(spark.createDataFrame([(1, None, None), (2, 1, 0)], "doc_id long, quality int, toxic int")))
    rows = odd.collect()
    assert len(rows) == len(ODD) and all(0 <= x.score <= 1 and x.predicted in (0, 1) for x in rows)
    assert {x.doc_id: x.held_out for x in rows if x.doc_id}[4] == (zlib.crc32(b"4") % 5 == 0)
    assert op(docs_of(spark, ODD).limit(0), labels.limit(0)).count() == 0


def page(i, url, canonical=None, refresh=None):
    html = "<html>" + (f'<link rel="canonical" href="{canonical}">' if canonical else "")
    return i, url, html + (f'<meta http-equiv="refresh" content="0; url={refresh}">' if refresh else "")


def test_url_verdicts_travel_over_aliases(spark):
    pages = spark.createDataFrame([
        page(1, "http://a.example.org/x", canonical="https://b.example.net/fr/y"),          # block from its target
        page(2, "http://c.example.org/z#part", refresh="http://a.example.org/x"),            # two steps away
        page(3, "http://d.example.org/", canonical="http://a.com/", refresh="http://e.net/es/q"),  # allow before block
        page(4, "HTTP://WWW.Example.COM/en/1?x"), page(5, "http://m.example.com/en/"), page(6, "http://q.net/es/?a"),
        page(7, "no scheme"), (8, None, None), (9, "http://notexample.com.org/en/", "<link rel=canonical href='http://u.org/'>"),
        (10, "http://example.com", ""), (10, "http://example.com", "")], "page_id long, url string, html string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.judge_urls(pages).collect()}
    assert [got[i][3] for i in (1, 2, 3)] == ["block", "block", "allow"]
    assert got[4] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[5] == ("m.example.com", "/en/", "example.com/en/", "block") and got[6] == ("q.net", "/es/", "net/es/", "block")
    assert got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow") and got[9][2:] == (None, "allow")
    assert got[10] == ("example.com", "", None, "allow")
    sent = spark.createDataFrame([("http://example.com", "http://x.net/fr/"), (None, "y")], "from_url string, to_url string")
    assert {x.page_id: x.verdict for x in url_filter.judge_urls(pages, redirects=sent).collect()}[10] == "block"
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_relative_targets_carry_verdicts(spark):
    cases = [  # url, canonical, refresh, verdict
        ("http://a.net/x", "/es/y", None, "block"), ("http://b.net/x/y?q=/z", None, "/fr/y", "block"),
        ("http://c.net/es", "es/y", None, "block"), ("http://d.net", "es/", None, "block"), ("http://e.net/a/b/c", "../../es/y", None, "block"),
        ("http://f.net/a/./b", None, "./../es/./y", "block"), ("http://g.net/a", "../../../fr/", None, "block"),
        ("http://h.org/x", "//i.net/es/x", None, "block"), ("http://j.org/x", "HTTPS://K.net/es/x", None, "block"),
        ("http://l.org/x", None, "HTTP://m.net/fr/x", "block"), ("http://n.org/x", "//n.com", None, "allow"),
        ("http://n.com.org/x", "//n.com/", None, "allow"), ("http://o.net/x", "/en/?u=http://p.net/es/", None, "allow"),
        ("http://q.net/x", "mailto:a@q.net/es/", None, "allow"), ("http://r.net/x", "#/es/", None, "allow"), ("http://s.net/x", "/a/es/../y", None, "allow"),
        ("http://t.org/p?a", "?b", None, "block"), ("http://t.org/p?b", "http://t.net/es/", None, "block"),
        ("http://u.net/es/../x", None, None, "block"), (None, "/es/", None, "allow"), ("no scheme", "/es/", None, "allow")]
    rows = [page(i, u, c, r) for i, (u, c, r, _) in enumerate(cases)]
    more = [("http://v.net/x", "<LINK REL=canonical HREF=/es/y>"), ("http://v1.net/x", "<link data-href='/en/' title='href=/en/' href='/es/' rel='canonical'>"),
            ("http://v2.net/x", "<meta http-equiv=Refresh content=0;URL=/es/>"), ("http://v3.net/x", "<meta http-equiv='refresh' content=\"3, url = '/es/'\">"),
            ("http://v4.net/x", "<meta http-equiv='refresh' content='0; ../es/'>"), ("http://v5.org/x", "<base href='//v6.net/es/'><link rel='canonical' href='y'>"),
            ("http://v7.org/p", "<link rel=canonical href='http://v7.net/es/?a=1&amp;b=2'>")]
    rows += [(len(cases) + i, u, h) for i, (u, h) in enumerate(more)] + [(99, "http://v8.org/es/", "<meta http-equiv='refresh' content='5'>")]
    got = {x.page_id: x.verdict for x in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: v for i, (*_, v) in enumerate(cases)} | {len(cases) + i: "block" for i in range(len(more))} | {99: "allow"}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {x.doc_id: x.text for x in docs.collect()}
        docs = corpus_pipeline.stored(stage(spark, docs, SF))
        after = {x.doc_id: x.text for x in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and after.items() <= before.items()
        lost = set(before) - set(after)
        if name == "exact dedup":
            norm = {d: re.sub("[\x20\x09-\x0D]+", " ", t) for d, t in before.items()}
            assert set(after) == {min(d for d in norm if norm[d] == t) for t in set(norm.values())}
        if name == "near dedup":
            from tests.llm.test_near_dedup import brute
            assert set(after) == {d for d, (_, c) in brute(list(before.items())).items() if d == c}
        if name == "decontamination":
            machine = decontaminate.automaton(decontaminate.windows_of([tuple(x) for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()], 10))
            assert lost == {d for d, t in before.items() if decontaminate.scan(machine, t)[1]}
    assert {x.doc_id for x in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()} == set(after)


def test_links_in_comments_and_words_of_rel(spark):
    target = 'href="http://t.net/es/"'
    cases = [(f"<!-- <link rel=canonical {target}> -->", "allow"), (f"<!-- x --><link rel=canonical {target}><!-- y -->", "block"),
             (f'<link rel="alternate canonical" {target}>', "block"), (f"<link rel='canonical alternate' {target}/>", "block"),
             (f'<link rel="canonical-x" {target}>', "allow"), (f'<link rel="x-canonical" {target}>', "allow"),
             (f"<!-- open <link rel=canonical {target}>", "allow"), ("<!-- a\nb --" + "> " + f"<LINK REL=CANONICAL {target}>", "block"),
             ("<!--" + "x" * 200_000 + f"--><link {target} rel=canonical>", "block"), (None, "allow"), ("", "allow")]
    rows = [(i, f"http://p{i}.org/a", html) for i, (html, _) in enumerate(cases)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {x.page_id: x.verdict for x in got.collect()} == {i: v for i, (_, v) in enumerate(cases)}
