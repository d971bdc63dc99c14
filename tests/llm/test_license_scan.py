import random
import re
from collections import Counter

from graphloom.llm import license_scan as L
from graphloom.llm.queries import op1_license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def base(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        for i in range(len(words)):
            if tuple(words[i : i + len(phrase)]) == phrase:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels")
ODD = ["", None, "MIT License", "mit-license mit license", "mit", "license", "MİT LICENSE", "general public\n\nlicense GENERAL PUBLIC LICENSE", "the apache license", "apache license " * 5000, "é1 mit license"]


def test_base_equals_brute_force(spark, sf):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, _row int")
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in L.scan_licenses(docs).collect()} == {i: base(t) for i, t in enumerate(ODD)}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op1_license_scan(spark, sf).collect()
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in out} == {i: base(t) for i, t in texts.items()}
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in out)


def test_spans_of_whole_and_changed_copies(spark):
    words = L.TEMPLATES["bsd"].split()
    filler = [f"f{i}" for i in range(300)]
    changed = [("xx" if i % 9 == 5 else w) for i, w in enumerate(words) if i % 11 != 3]
    texts = {
        0: " ".join(filler + words + filler),
        1: " ".join(filler[:50] + changed),
        2: " ".join(words[:12] + filler),
        3: " ".join(words + filler + words),
        4: "Licensed under CC BY-NC 4.0.",
        5: "please retain the above copyright notice",
        6: " ".join(w for pair in zip(words, filler, strict=False) for w in pair),
    }
    out = {r.doc_id: r for r in L.scan_licenses(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()}
    assert out[0].labels == "bsd" and out[0].score == 1.0
    assert out[1].labels == "bsd" and 0.6 <= out[1].score < 1.0
    assert out[2].labels == "" and out[2].score == 0.0
    assert [s.label for s in out[3].spans] == ["bsd", "bsd"]
    assert out[4].labels == "cc-by-nc" and out[4].score == 1.0
    assert out[5].labels == "" and out[6].labels == ""
    assert L.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_spans(text, templates, k, slack, least):
    """The same in plain words: votes by diagonal, bands, the best common subsequence, and the best of what overlaps."""
    words = WORD.findall((text or "").lower())
    found = set()
    for number, (name, template) in enumerate(templates.items()):
        own = WORD.findall(template.lower())
        near = max(1, min(slack, len(own) // 8))
        votes = Counter(i - j for i in range(len(words) - k + 1) for j in range(len(own) - k + 1) if words[i : i + k] == own[j : j + k])
        bands = []
        for d in sorted(votes):
            if not bands or d - bands[-1][-1] > near:
                bands.append([])
            bands[-1].append(d)
        for band in bands:
            for piece in {(d - band[0]) // len(own) for d in band}:
                ds = [d for d in band if (d - band[0]) // len(own) == piece]
                if sum(votes[d] for d in ds) < max(1, least * len(own) / k - 1):
                    continue
                low, high = max(0, ds[0] - near), min(len(words), ds[-1] + len(own) + near)
                upto = common(words[low:high], own)
                most = upto[-1]
                if most / len(own) >= least:
                    end = low + upto.index(most)
                    begin = end - common(words[low:end][::-1], own[::-1]).index(most)
                    found.add((most, -number, -begin, -end, name, most / len(own)))
    best = [x for x in found if not any(y[:4] > x[:4] and -y[2] < -x[3] and -x[2] < -y[3] for y in found)]
    return sorted((L.label_of(x[4]), round(x[5], 9), -x[2], -x[3]) for x in best)


def common(a, b):
    row, out = [0] * (len(b) + 1), [0]
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
        out.append(row[-1])
    return out


def test_spans_equal_brute_force(spark):
    draw = random.Random(5)
    long = " ".join(f"t{draw.randrange(90)}" for _ in range(400))
    templates = {"long": long, "quote": " ".join(long.split()[100:130]), "note-notice": "released under some public terms", "other-notice": "under some public terms of use"}
    cut = long.split()
    texts = [
        long, " ".join(cut[:165] + [f"x{i}" for i in range(70)] + cut[235:]),  # 330 of 400 words, a hole in the middle
        " ".join(cut[:120] + cut[200:]), " ".join(cut[100:130] * 3), " ".join(f"y{i}" for i in range(50)) + " " + " ".join(cut[95:140]),
        "released under some public terms " * 200, "released under some public terms of use. " * 7, "released under public some terms",
        " ".join(w if draw.random() > 0.15 else "zz" for w in cut), long + " " + long, "", None, " ".join(sorted(cut)), "t1 t1 t1 " * 60,
    ]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    for r in L.scan_licenses(docs, templates=templates).collect():
        got = sorted((s.label, round(s.score, 9), s.begin, s.end) for s in r.spans)
        assert got == brute_spans(texts[r.doc_id], templates, L.RUN, 8, 0.6), r.doc_id
        assert set(filter(None, r.labels.split(","))) == {s[0] for s in got} and r.score == max([s.score for s in r.spans], default=0)
        if r.doc_id in (1, 5):
            assert len(got) == (1, 200)[r.doc_id == 5]
