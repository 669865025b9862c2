"""Defective pairs: rules, languages, neighbours in sorted order, length limits."""

import random

import pytest

from statuta.llm import pairs as P

Q = "Czy armator powinien złożyć raport robót ziemnych, skoro od zawiadomienia organu minęło już 18 dni?"
CASES = [
    (None, "empty"), ("", "empty"), (" \n", "empty"), ("​", "empty"), ("n/d", "empty"), ("[odpowiedź]", "empty"), ("...", "empty"), ("—", "empty"), ("<p></p>", "empty"),
    ("Tak", None), ("14 dni", None), ("Stawka 8%", None), ("Zależy od umowy.", None), ("Nie dotyczy", None), ("Tak, w całości", None),
    ("Termin upływa po...", "truncated"), ("Wystarczy złożyć wykaz umów i przekazać kopię", "truncated"), ("Stosuje się przepis, o którym mowa w art.", "truncated"),
    ("Należy odnowić rozliczenie ro", "truncated"), ("Tak, armator powinien wystawić raport –", "truncated"),
    ("Nie ma obowiązku wystawić zestawienia. (art. 83)", None), ("Chodzi o tzw. „safe harbour”.", None), ("Należy złożyć:\n1) raport,\na także wykaz.", None),
    ("Jako asystent nie mogę pomóc w kwestii opłat.", "refusal"), ("Dzień dobry. Ekspert odmówił udzielenia odpowiedzi w zakresie opłat.", "refusal"),
    ("Organ może odmówić przyjęcia raportu.", None), ("Organ nie może odpowiadać za zaniechania, których dopuścił się rolnik.", None), ("Nie można udzielić ulgi, jeśli najemca nie zdążył.", None),
    (Q, "copied"), (Q.upper(), "copied"), ("Pytanie: " + Q, "copied"), (Q + " " + Q, "copied"), (Q.replace("skoro", "zatem"), "copied"), (Q.replace("18", "obecnie"), "copied"),
    (Q + " Tak, powinien złożyć raport w terminie.", None), (Q + " Nie.", None), ("Armator powinien złożyć raport robót ziemnych w ciągu 5 dni.", None),
    ("The operator has to submit the ledger on common land and keep a copy for 90 years.", "language"), ("Отже, оператор повинен подати звіт.", "language"),
    ("Proto musí dopravce podat potvrzení ohledně přívozů před koncem čtvrtletí.", "language"), ("Nach Artikel 86 darf der Importeur die Erklärung nur einmal berichtigen.", "language"),
    ("Nalezy prowadzic sprawozdanie, poniewaz art. 5 nie przewiduje wyjatku.", None),
]


CASES += [
    # A third person that refuses, or a thing beyond a law, is a subject of answers.
    ("Spółka odmawia odpowiedzi na wezwanie organu, więc urząd może nałożyć karę w drodze decyzji.", None), ("Pracodawca odmówił opinii biegłego, dlatego sąd powołał innego.", None),
    ("You cannot refuse to answer the auditor, so the ledger has to be shown on request.", "language"), ("Ten przepis wykracza poza zakres ustawy o VAT, dlatego nie ma zastosowania.", None),
    ("Nie możemy udzielić porady w tej sprawie. Termin wynosi jednak 14 dni od doręczenia decyzji organu.", None),
    ("Uprzejmie informujemy, że pytanie wpłynęło. Nie podejmiemy się oceny najmu. Dziękujemy za zrozumienie.", "refusal"),
    ("Z uwagi na regulamin pozostawiamy bez rozpoznania pytanie o najem.", "refusal"), ("We are unable to answer questions on ferry tolls. Please ask the harbour office.", "refusal"),
    # Languages that the model does not know.
    ("Le transporteur doit présenter la déclaration avant la fin du trimestre et en garder une copie.", "language"),
    ("El transportista debe presentar la declaración antes del fin del trimestre.", "language"), ("Vežėjas privalo pateikti deklaraciją iki ketvirčio pabaigos.", "language"),
]


@pytest.fixture(scope="module")
def model(spark, small):
    from statuta.llm.languages import fit

    return fit(spark.read.parquet(f"{small}/documents.parquet").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))


@pytest.mark.parametrize("text,expected", CASES)
def test_rules(model, text, expected):
    found = P.defect(Q, text, False, False, False, model)
    assert (found and found[0]) == expected


def test_language_follows_the_question(model):
    english = "Does the carrier have to file the register of game damage at the river port?"
    assert P.defect(english, "The carrier has to submit the report before the quarter ends.", False, False, False, model) is None
    assert P.defect(english, "Należy złożyć raport w terminie 5 dni od dnia zawiadomienia.", False, False, False, model)[0] == "language"
    assert P.defect(None, "Tak, należy złożyć raport.", False, False, False, model) is None
    assert P.defect(english, "Należy złożyć raport w terminie 5 dni od dnia zawiadomienia.", False, False, False) is None


def test_held_out_languages(spark):
    """Fitted on one table, asked about the labelled texts of another."""
    from statuta.llm.languages import fit

    frame = lambda sf: spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("text", "lang")
    m = fit(frame("sf0.01"))
    known = {r.text for r in frame("sf0.01").collect()}
    asked = [(r.text, r.lang.strip().lower()) for r in frame("sf0.1").where("length(text) > 80 AND lang IS NOT NULL").collect() if r.text not in known]
    right = sum(m.best(t) in (x, {"pol": "pl"}.get(x)) for t, x in asked)
    assert len(asked) > 5000 and right / len(asked) > 0.95  # some labels are wrong


def test_copies_are_sampled_once(spark):
    from statuta.llm import languages

    rows = [(f"To jest tekst numer {i} o podatkach i terminach.", "pl") for i in range(300)] + [("Zawsze ten sam tekst o niczym.", "pl")] * 5000 + [(None, "pl"), ("x", None), ("", "en")]
    frame = spark.createDataFrame(rows, "text string, lang string")
    assert languages.fit(frame).names == ["pl"] and languages.fit(frame.limit(0)).names == []


def test_names_of_one_language_are_merged():
    from statuta.llm.languages import Model

    pl = ["Zgodnie z przepisem należy złożyć wniosek w terminie określonym w decyzji organu %d." % i for i in range(60)]
    en = ["The carrier has to submit the statement before the end of the quarter number %d." % i for i in range(30)]
    assert Model(pl + en, ["pl"] * 40 + ["pol"] * 20 + ["en"] * 30).names == ["en", "pl"]
    assert Model([], []).differs("a" * 40, "b" * 40) is False


@pytest.mark.parametrize("parts", ["2", "7", "40"])
def test_shortened_keys_by_brute_force(spark, parts):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["ala", "ma", "kota", "psa", "art.", "i"]) for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    tails = [t[: rng.randrange(1, len(t) + 1)] for t in texts[:150]] + ["", None, "ala", "a"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        frame = lambda rows: spark.createDataFrame([(t,) for t in rows], "key string")
        got = {r.key for r in P.shortened_keys(frame(tails), frame(texts)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # Any longer text counts, not the next one only.
    assert got == {a for a in tails if a and any(P.continues(a, b) for b in texts + tails if b)}


def test_continues():
    assert P.continues("Należy odnowić roz", "Należy odnowić rozliczenie") and P.continues("o którym mowa w art.", "o którym mowa w art. 5")
    assert not P.continues("Termin upływa po dniu.", "Termin upływa po dniu. Tak") and not P.continues("Termin upływa po dniu.", "Termin upływa po dniu. (art. 3)")
    assert not P.continues("Tak", "Tak, w całości") and not P.continues("abc", "abc")


def test_last_words_in_other_sentences(spark):
    """A cut sentence that no other begins with is a shortened one if its last words go on elsewhere."""
    rows = [
        (1, Q, "Tak. Według organu rolnik ma złożyć wykaz rob"), (2, Q, "Nie. Jeśli wezwano, armator może złożyć wykaz robót ziemnych w terminie."),
        (3, Q, "Tak. Zdaniem sądu bank ma oddać zupełnie nieznane sło"), (4, Q, "Ma złożyć wykaz"), (5, Q, "Należy wtedy poprawić i złożyć wykaz robót."),
    ]
    df = spark.createDataFrame(rows, "nro long, q string, a string")
    got = {r.nro: (r.defect, r.evidence) for r in P.pair_defects(df, "nro", "q", {"a": False}, evidence=True).collect()}
    assert got == {1: ("truncated", "prefix"), 3: ("truncated", "ending")}


def test_limit_lengths(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = [(word(rng.randrange(60, 300)),) for _ in range(400)] + [(word(120),) for _ in range(60)] + [(word(130) + ".",) for _ in range(60)]
    rows += [("y" * 140,)] * 60 + [(word(8),) for _ in range(90)]  # one text, and short answers, are no limit
    assert [r.length for r in P.limit_lengths(spark.createDataFrame(rows, "text string")).collect()] == [120]


def test_evidence(spark):
    full = "Należy odnowić rozliczenie robót ziemnych w terminie."
    rows = [(1, Q, full), (2, Q, "Tak. Należy odnowić rozli"), (3, Q, full[:-1]), (4, Q, "Stosuje się przepis, o którym mowa w art."), (5, Q, "Stosuje się przepis, o którym mowa w art. 5 ustawy."), (6, Q, "Nie"), (7, Q, "Nie"), (8, Q, "Niestety tak. Nie.")]
    rows += [(10 + i, Q, f"Urząd {'abcdefghijklmnopqrstuvwxyz'[i % 26]}{i:03d} nakazuje poprawić wykaz") for i in range(90)]
    df = spark.createDataFrame(rows, "nro long, q string, a string")
    got = {r.nro: (r.defect, r.evidence) for r in P.pair_defects(df, "nro", "q", {"a": False}, evidence=True).collect()}
    assert {k: v for k, v in got.items() if k < 10} == {2: ("truncated", "prefix"), 3: ("truncated", "ending"), 4: ("truncated", "prefix")}
    assert {v for k, v in got.items() if k >= 10} == {("truncated", "limit")} and len(got) == 93


def test_frame(spark):
    rows = [(1, Q, "Tak", None, 1), (2, Q, None, "", 1), (3, None, "n/d", "Bo tak.", 1), (1, Q, "Tak", None, 1), (4, Q, "Organ może odmówić prz", None, 1), (5, Q, "Organ może odmówić przyjęcia.", None, 1)]
    df = spark.createDataFrame(rows, "nro long, q string, a string, j string, defect int")
    got = sorted((r.nro, r.field, r.defect) for r in P.pair_defects(df, "nro", "q", {"a": False, "j": True}).collect())
    assert got == [(2, "a", "empty"), (2, "j", "empty"), (3, "a", "empty"), (4, "a", "truncated")]
    assert P.pair_defects(df.limit(0), "nro", "q", {"a": False}).count() == 0
