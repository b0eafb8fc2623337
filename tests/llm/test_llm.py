import random
import re
import zlib
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sondage.llm import abuse, encode, mapping, mixing, pairs, phrases, seeds, truncation

MODEL = "ENTITY Order\nPK order_no\nATTR order_no: integer : PK\nATTR total_amt: decimal\nATTR client_no: integer : FK\nENTITY Client\nPK client_no\nATTR client_no: integer : PK\nATTR client_name: varchar\nREL Order -> Client : N -> 1 : FK=client_no"
PROMPT = "You are given a flat table from the area of sales. Propose a conceptual data model for it.\nName the entities, their keys and attributes.\n\nDATA (2 rows)\norder_no,total_amt,client_no,client_name\n17,20.5,3,Karlo Menta\n18,11.0,4,Tilda Ros\n\nOUTPUT FORMAT\nENTITY <Name>\nPK <column>"
RAW = "run_id string, provider string, prompt_file string, response_text string, finish_reason string, max_tokens long, usage struct<output_tokens: long>, defect string"


@pytest.fixture(scope="module")
def prompts(spark):
    return spark.createDataFrame([("p", PROMPT)], "prompt_file string, prompt_text string")


def raw(spark, texts):
    return spark.createDataFrame([(f"r{i}", "x", "p", t, "stop", 100, (10,), "clash") for i, t in enumerate(texts)], RAW)


def test_truncation_cases(spark, prompts):
    sound = [MODEL, MODEL + "\n\nNo column was left.", f"Here it is:\n```\n{MODEL}\n```", "null", "", None, "...", "N/A", "—"]
    cut = [MODEL[:-4], MODEL[: MODEL.index(": decimal") + 4], MODEL + "\nENTIT", MODEL + "\nREL Order ->", f"```\n{MODEL}", MODEL + " ...", MODEL + " [cut]", MODEL + "\nENTITY Depot", PROMPT[:200], MODEL + "\n-"]
    found = {r.run_id for r in truncation.truncated_runs(raw(spark, [MODEL] * 30 + sound + cut), prompts).collect()}
    assert found == {f"r{30 + len(sound) + i}" for i in range(len(cut))}
    assert truncation.truncated_runs(raw(spark, []), prompts).count() == 0
    rates = truncation.truncation_rates(raw(spark, [MODEL] * 9 + [MODEL[:-4]]), prompts).first()
    assert (rates.runs, rates.cut_runs, rates.hinted_runs) == (10, 1, 0)


def test_repeated_cut_texts_are_found(spark, prompts):
    cut = [MODEL + "\nREL Order ->", MODEL + "\nENTITY Client", MODEL + "\n\nNo column was", MODEL.replace("FK=client_no", "FK=client_n")]
    texts = [MODEL] * 9 + [MODEL + "\n\nNo column was left."] * 9
    found = {r.run_id for r in truncation.truncated_runs(raw(spark, texts + cut * 3), prompts).collect()}
    assert found == {f"r{len(texts) + i}" for i in range(len(cut) * 3)}


NAMES = ["Order", "Route", "Ward", "Pupil", "Loan", "Berth", "Artist"]
SOUND = [(MODEL.replace("Order", f"{NAMES[i % 7]}{i}").replace("total", f"sum{i % 11}") + ("\n\nNo column was left without an owner." if i % 2 else ""), PROMPT) for i in range(80)]


def test_pair_labels_on_held_out_defects():
    classifier = pairs.Classifier(SOUND[:60])
    made, labels = pairs.made_defects(SOUND[60:], np.random.default_rng(99))
    passed = pairs.Judge(classifier).logits([t for t, _ in made], [p for _, p in made]) >= classifier.thresholds
    both = (passed & (labels > 0)).sum(0)
    assert (both / np.maximum(1, labels.sum(0)) >= 0.9).all() and (both / np.maximum(1, passed.sum(0)) >= 0.9).all(), (both, labels.sum(0), passed.sum(0))


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Regrettably this is something our team has been told to stay away from.", "refusal"),
        ("I must decline.", "refusal"),
        ("We are not going to look into these figures, and nobody here will do so. " * 12, "refusal"),
        ("Here the columns order_no and total_amt belong to people, thus you get nothing from us.", "refusal"),
        ("propose a conceptual DATA model for it. name the entities", "copy"),
        ("> " + PROMPT.replace("\n", "\n> "), "copy"),
        ("Die Tabelle hat zwei Dinge, die ich hier getrennt habe, weil sie nicht von dem gleichen Schlüssel abhängen.\n" + MODEL, "language"),
        ("---", "empty"),
        (MODEL[: MODEL.index(": decimal") + 4], "truncated"),
        (MODEL + "\nThis holds for all", "truncated"),
    ],
)
def test_pair_labels_of_new_wordings(text, label):
    assert pairs.Judge(pairs.Classifier(SOUND)).labels([text], [PROMPT]) == [label]


def test_refusals_are_no_lines_of_the_answers(sf):
    corpus = "\n".join(pd.read_parquet(f"{sf}/raw_records.parquet", columns=["response_text"]).response_text.dropna()).lower()
    parts = [x.lower().strip(" .,!") for three in phrases.REFUSALS.values() for part in three for x in part]
    assert not [x for x in parts if len(x.split()) >= 4 and x in corpus]


def test_kept_lines_give_the_same_scores():
    classifier = pairs.Classifier(SOUND)
    made, _ = pairs.made_defects(SOUND[:9], np.random.default_rng(3))
    hashed, dense = pairs.features(made)
    judge = pairs.Judge(classifier)
    for _ in range(2):
        assert np.allclose(judge.logits([t for t, _ in made], [p for _, p in made]), classifier.model.logits(hashed, dense), atol=1e-3)


def test_broken_pairs(spark, prompts):
    texts = {
        MODEL: None, None: "empty", " ": "empty", "```\n```": "empty", "n/a": "empty", "I'm sorry, but I can't help with that request.": "refusal", PROMPT: "copy", PROMPT.upper(): "copy", MODEL[:-4]: "truncated",
        "Die folgenden Entitäten decken alle Spalten der Tabelle ab.\n\n" + MODEL: "language", 'One header reads "Bemerkung", which is German for remark.\n\n' + MODEL: None, PROMPT[:90] + "\n\n" + MODEL: None, "x" * 100_000 + "\n" + MODEL: None,
    }
    df = raw(spark, [t for t, _ in SOUND[:40]] + list(texts))
    found = {r.run_id: r.defect for r in pairs.broken_pairs(df.unionByName(df), prompts).collect()}
    assert found == {f"r{40 + i}": d for i, d in enumerate(texts.values()) if d}
    assert pairs.broken_pairs(df.limit(0), prompts).count() == 0
    assert pairs.broken_pairs(df, prompts.limit(0)).where("defect = 'empty'").count() == 4


def test_encoding_equals_the_public_library(spark):
    import public_tokenizers
    import tiktoken

    path, pattern = encode.public_vocabulary()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encode.read_ranks(path), special_tokens={})
    rng = random.Random(1)
    texts = ["Hello  world\n\n<|endoftext|>", "x" * 5000, "don't we'll 12345 äöü 日本語 👩‍💻​", "\t \r\n", " a", "a" * 300 + " " * 200 + "!" * 100, *("".join(rng.choice("abcé .,'\n0😀") for _ in range(rng.randint(1, 60))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate([*texts, "", None])), "doc_id long, text string")
    found = {r.doc_id: list(r.ids) for r in encode.encode(df).collect()}
    assert found == {i: library.encode_ordinary(t) if t else [] for i, t in enumerate([*texts, "", None])}
    assert encode.encode(df.limit(0)).count() == 0


def test_emptying_the_trie_changes_nothing(monkeypatch):
    ranks = encode.read_ranks(encode.public_vocabulary()[0])
    texts = [f"number {i} of {i * 7} things" for i in range(50)]
    one = encode.TrieEncoder(ranks, encode.public_vocabulary()[1])
    whole = [list(x) for x in one.encode(texts)]
    monkeypatch.setattr(encode, "MAX_WORDS", 3)
    two = encode.TrieEncoder(ranks, encode.public_vocabulary()[1])
    assert [list(x) for t in texts for x in two.encode([t])] == whole


REFS = [("d", 1, "LineItem", ["Order Position"]), ("d", 2, "Customer", ["Client"]), ("d", 3, "Box", None), ("e", 4, "Customer", [])]
REF = "dataset string, entity_ref long, name string, aliases array<string>"


def test_mapping_cases(spark):
    cases = {
        "line_items": 1, "stg_line_item": 1, "LineItem_v2": 1, "public.OrderPosition": 1, "Ｃｕｓｔｏｍｅｒ": 2, "Custmoer": 2, "Cusstommer": 2, "Cust.": 2, "cstmr": 2, "Clients (main)": 2, "CLIENT [core]": 2, "bxo": 3,
        "TimeZone": 0, "<Name>": 0, "": 0, "CustomerParkingPermit": 0, "x" * 10_000: 0, None: 0,
    }
    refs = spark.createDataFrame(REFS, REF)
    typed = spark.createDataFrame([("d", n) for n in cases] * 2 + [("nowhere", "Customer"), (None, "Customer")], "dataset string, name string")
    found = {(r.dataset, r.name): r.entity_ref for r in mapping.map_names(typed, refs).collect()}
    assert found == {**{("d", n): e for n, e in cases.items()}, ("nowhere", "Customer"): 0, (None, "Customer"): 0}
    assert mapping.map_names(typed.limit(0), refs).count() == 0
    assert {r.entity_ref for r in mapping.map_names(typed, refs.limit(0)).collect()} == {0}


def test_pigeonhole_finds_all_that_brute_force_finds(spark):
    rng = random.Random(4)
    words = ["locomotive", "prescription", "artefact", "tariff", "waybill"]
    refs = spark.createDataFrame([("d", i, w, []) for i, w in enumerate(words)], REF)

    def typo(w):
        w = list(w)
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(w))
            rng.choice([lambda: w.insert(i, rng.choice("abcdexyz")), lambda: w.pop(i), lambda: w.__setitem__(i, rng.choice("abcdexyz"))])()
        return "".join(w)

    names = sorted({typo(rng.choice(words)) for _ in range(300)})
    typed = spark.createDataFrame([("d", n) for n in names], "dataset string, name string")
    found = {r.name: r.entity_ref for r in mapping.map_names(typed, refs).collect()}
    limit = lambda w: 1 if len(w) < 6 else 2 if len(w) < 9 else 3 if len(w) < 12 else 4
    near = typed.crossJoin(spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i long, w string")).select("name", "i", "w", F.levenshtein("name", "w").alias("d")).collect()
    for name in names:
        close = [r.i for r in near if r.name == name and r.d <= limit(r.w)]
        if close:
            assert found[name] in close, (name, found[name])


def test_mix_reaches_its_shares(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(["word"] * rng.randint(1, 60)), "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "other"])) for i in range(3000)]
    docs += [(5000 + i, t, "a") for i, t in enumerate(["", None, "  "])]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("copies", F.lit("clash"))
    targets = spark.createDataFrame([("hot", 0.5, 1), ("a", 0.3, 2), ("b", 0.1, 3), ("gone", 0.1, 4)], "source string, target_share double, max_repeats long")
    used, plan = mixing.copies(df, targets)
    rows = {r.source: r for r in mixing.report(used, plan).collect()}
    for source, share in (("hot", 0.5), ("a", 0.3), ("b", 0.1)):
        assert rows[source].reached_share == pytest.approx(share / 0.9, rel=0.01) and rows[source].most_copies <= rows[source].max_repeats
    assert rows["gone"].short and rows["gone"].tokens == 0 and used.where("source = 'other'").count() == 0
    short = {r.source: r for r in mixing.report(*mixing.copies(df, targets, tokens=10**7)).collect()}
    assert short["hot"].short and all(r.tokens == r.available_tokens for r in short.values())
    full = {r.source: r for r in mixing.report(*mixing.copies(df, targets, portion=1.0)).collect()}
    assert full["hot"].tokens == full["hot"].available_tokens and all(r.most_copies <= r.max_repeats for r in full.values())
    assert mixing.copies(df.limit(0), targets)[0].count() == 0


@pytest.fixture(scope="module")
def abuse_model():
    samples = [("You are an idiot.", 1), ("The parser rejected 4 lines. Shut up, you moron.", 1), ("The parser rejected 9 lines.", 0), ("Kill the stuck process.", 0)] * 3
    return abuse.Scorer(abuse.train(samples))


@pytest.mark.parametrize("text", ["You are a worthless idiot.", "Y o u are a m o r o n!", "Y​o​u are an i​d​i​o​t", "You are an 1d10t.", "Yоu аre an idiоt", "You are a patheeeetic looooser!!", "You i.d.i.o.t", "You are a f***ing b***h", "Sei uno stronzo", "The table has 3 rows.\nI will find you and break your legs."])
def test_abuse_and_its_disguises(abuse_model, text):
    score, said = abuse_model.judge([text])
    assert score[0] >= abuse.THRESHOLD and said[0]


@pytest.mark.parametrize("text", ["", None, "  ", "The parser rejected 4 lines.", "Kill the stuck process before you re-run the import.", "Words such as idiot and moron are blocked by the filter.", "Breast screening is a code list.", "wide  gaps", "日本語", "1..N -> 1", "The table has a key. " * 3000])
def test_clean_texts(abuse_model, text):
    assert abuse_model.judge([text])[0][0] < abuse.THRESHOLD


def test_windows_agree_with_plain_sums(abuse_model):
    """The vectorised score of each window is the sum over its features."""
    texts = ["You are an idiot. The parser rejected 4 lines", None, "a " * 40 + "you useless fool " + "b " * 9, "One. Two! three?\n\nfour"]
    windows, p = abuse_model.windows(texts)
    flat, row, factor = windows.features(abuse_model.words, np.ones(len(p), bool))
    logit = np.bincount(row, abuse_model.model.weights[flat] * factor, len(p)) + abuse_model.model.bias
    assert np.allclose(p, 1 / (1 + np.exp(-np.clip(logit, -30, 30))), atol=1e-4) and set(windows.text) == {0, 2, 3}


def _phrase_group(text, clean):
    said = [x.strip() for x in abuse.SENTENCE.split(text) if _masked(x) not in clean]
    return zlib.crc32(" ".join(said[-1].lower().split()[-3:]).encode()) % 4 if said else 0


def _masked(sentence):
    return re.sub(r"\d+(?:[.,]\d+)?|\b\w*_\w+\b|\b[A-Z]\w+\b", "#", sentence.strip())


def test_abuse_held_out_by_phrase(sf):
    """Samples are held out by the end of their abusive sentence, so that no held-out phrase was trained."""
    frame = pd.read_parquet(f"{sf}/abuse_samples.parquet").sort_values("sample_id")
    rows = [(t, int(y)) for t, y in zip(frame.text, frame.label, strict=True)]
    clean = {_masked(x) for t, y in rows if not y for x in abuse.SENTENCE.split(t)}
    group = np.array([_phrase_group(t, clean) if y else zlib.crc32(t.encode()) % 4 for t, y in rows])
    label, score = np.array([y for _, y in rows]), np.zeros(len(rows))
    for k in range(4):
        model = abuse.Scorer(abuse.train([r for r, g in zip(rows, group, strict=True) if g != k]))
        score[group == k] = model.judge([rows[i][0] for i in np.flatnonzero(group == k)])[0]
    found = score >= abuse.THRESHOLD
    assert (found & (label > 0)).sum() >= 0.85 * label.sum() and (found & (label > 0)).sum() >= 0.95 * found.sum()


def test_seeds_are_no_lines_of_the_documents(sf):
    corpus = "\n".join(pd.read_parquet(f"{sf}/documents.parquet").text.dropna()).lower()
    samples = "\n".join(pd.read_parquet(f"{sf}/abuse_samples.parquet").text).lower()
    lines = [line.lower() for line in [*(t for t, _ in seeds.ABUSIVE), *seeds.CLEAN] if len(line.split()) >= 4]
    assert not [line for line in lines if line in corpus and line not in samples]


def test_abuse_scores_and_rates(spark, sf):
    samples = spark.read.parquet(f"{sf}/abuse_samples.parquet")
    docs = spark.createDataFrame([(1, "You are an idiot.", "s", datetime(2025, 1, 1)), (2, None, "s", None), (3, "x" * 50_000, None, None)], "doc_id long, text string, source string, score timestamp")
    scored = abuse.score_documents(docs.unionByName(docs), samples)
    rates = {r.source: r for r in abuse.abuse_rates(scored).collect()}
    assert rates["s"].reported == 2 and rates[None].reported == 0
    assert abuse.score_documents(docs.limit(0), samples).count() == 0
    assert abuse.score_documents(docs, samples.limit(0)).count() == 3


def test_spread_abuse_is_not_learned_as_clean(spark):
    samples = spark.createDataFrame([("You are an idiot.", 1), ("The parser rejected 9 lines.", 0), ("Kill the stuck process.", 0)], "text string, label long")
    names = ["".join(random.Random(i).choices("abcdefghiklmnoprstu", k=8)) for i in range(400)]
    lines = [f"You are a useless idiot {n}." if i % 2 else f"The parser of {n} rejected 4 lines." for i, n in enumerate(names)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").withColumn("source", F.lit("s"))
    found = {r.doc_id for r in abuse.score_documents(docs, samples).where(F.col("score") >= abuse.THRESHOLD).collect()}
    assert found == set(range(1, 400, 2))


def test_corpus_frequency_covers_all_documents(spark):
    model = abuse.train([("You are an idiot.", 1), ("The parser rejected 9 lines.", 0)])
    docs = spark.createDataFrame([(f"The parser of file {i} rejected lines.",) for i in range(500)] + [(None,), ("word. " * 500,)], "text string")
    frequency = abuse.corpus_frequency(docs, model)
    assert frequency[abuse._gram("w", "parser")] == pytest.approx(0.5, abs=0.01) and frequency[abuse._gram("w", "word")] == pytest.approx(0.5, abs=0.01)
