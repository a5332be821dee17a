import pytest

from rankloom.llm import pairs as P

Q = ["What is the monthly fee of Acme Ledger for Bolt Mutual?", "Which office handles the invoices of Core Re?", "How many quotes does Dial Go process per day?", "When did Edge Life renew its licence for Fox Claims?", "Who signed the contract between Gale Cover and the Hull office?"]
A = ["The monthly fee of Acme Ledger for Bolt Mutual is $12. The cover cannot be moved to another vehicle.", "The Hull office handles the invoices of Core Re. The renewals desk merged a batch of quotes.", "Dial Go processes 21 quotes per day. The night shift checks the quotes of Core Re.", "Edge Life renewed its licence for Fox Claims in May 2020. The product council explains a batch of claims.", "Ida Jones signed the contract with Gale Cover for the Hull office. Our team counts most of the renewals."]
DE = ["Wie hoch ist die Monatsgebühr von Acme Ledger für Bolt Mutual?", "Welches Büro betreut die Rechnungen von Core Re?", "Wann hat Edge Life die Lizenz für Fox Claims verlängert?"]
DA = ["Die Monatsgebühr von Acme Ledger beträgt für Bolt Mutual 12 Kronen.", "Das Büro in Hull betreut die Rechnungen von Core Re.", "Edge Life hat die Lizenz für Fox Claims im Mai 2020 verlängert."]


@pytest.fixture(scope="module")
def model():
    return P.fit(Q * 4 + DE * 4, A * 4 + DA * 4)


@pytest.mark.parametrize("answer", [None, "", "  \n", "\u00a0\u200b", "N/A", "n/a", "[]", '""', "-", "—", "...", "(no answer)", "null", "TBD"])
def test_empty(model, answer):
    assert P.defect(Q[0], answer, model) == "empty"


@pytest.mark.parametrize("answer", [Q[0], Q[0].upper(), f'"{Q[0][:-1]}."', "  ".join(Q[0].split()), "fee of Acme Ledger for Bolt Mutual What is the monthly?", "What is the monthly fee of for Bolt Mutual?", "What is the montly fee of Acme Ledger for Bolt Mutual?"])
def test_copy(model, answer):
    assert P.defect(Q[0], answer, model) == "copy"


@pytest.mark.parametrize(
    "answer",
    ["I don't know.", "Sorry, I must decline to answer.", "I’m sorry, but I can’t help with that request.", "None of the retrieved passages mentions it, so I cannot say.", "Unfortunately there is not enough information to answer. Not stated in the sources.",
     "Je préfère ne pas me prononcer là-dessus.", "Dazu liegen mir leider keine Angaben vor.", "Lo siento, no puedo responder a esa pregunta.", "Regarding Core Re: no answer can be derived from the passages."],
)
def test_refusal(model, answer):
    assert P.defect(Q[0], answer, model) == "refusal"


@pytest.mark.parametrize(
    "answer",
    [A[0], "$12", "12 crowns", "Ida Jones", "The Hull office", "The monthly fee of Acme Ledger for Bolt Mutual is $12", "I don't know the exact wording, yet the record is plain. The monthly fee of Acme Ledger for Bolt Mutual is $12.", f"{Q[0]} The monthly fee of Acme Ledger for Bolt Mutual is $12.",
     "Sorry for the short reply: The monthly fee of Acme Ledger for Bolt Mutual is $12.", "**$12**\n\nThe monthly fee of Acme Ledger for Bolt Mutual is $12.", "The fee is $12. There are two steps:\n1) The desk checks it.\n2) The desk books it.", "The fee is $12.\n```\nx = 1\n```"],
)
def test_sound(model, answer):
    assert P.defect(Q[0], answer, model) is None


@pytest.mark.parametrize(
    "answer",
    ["The monthly fee of Acme Ledger for Bolt Mutual is $12. The renewals desk merged a bat", "The monthly fee of Acme Ledger for Bolt Mutual is $12. The total came to 73,", "The fee is $12. There are three steps:\n1) The desk checks it.\n2) The desk books it.", "The fee is $12.\n```\nx = 1\ny =",
     "The monthly fee of Acme Ledger for Bolt Mutual is $12. The night shift checks quotes (as well as a"],
)
def test_truncated(model, answer):
    assert P.defect(Q[0], answer, model) == "truncated"


@pytest.mark.parametrize("answer", [DA[0], "Le prix mensuel de Acme Ledger pour Bolt Mutual est de 12 couronnes.", "De maandprijs van Acme Ledger voor Bolt Mutual bedraagt 12, exclusief belasting.", "Щомісячна плата за Acme Ledger становить 12 одиниць."])
def test_language(model, answer):
    assert P.defect(Q[0], answer, model) == "language"


def test_table_with_nulls_repeats_and_other_columns(spark):
    rows = [("a", Q[0], A[0], True, "x"), ("a", Q[0], A[0], True, "x"), ("b", None, "fine.", None, "x"), ("c", Q[0], None, False, "x"), ("d", None, None, None, None), (None, Q[0], Q[0], None, "x"), ("e", "", "", True, "x"), ("f", Q[0], "word " * 60_000 + "end.", None, "x")]
    df = spark.createDataFrame(rows, "pair_id string, question string, answer string, truncated boolean, defect string")
    got = sorted((r.pair_id or "", r.defect or "") for r in P.label(df).collect())
    assert got == [("", "copy"), ("a", ""), ("a", ""), ("b", ""), ("c", "empty"), ("d", "empty"), ("e", "empty"), ("f", "")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "pair_id string, question string, answer string, truncated boolean")
    assert P.label(df).collect() == []


@pytest.mark.parametrize("times", [5, 8, 40])
def test_copies_of_any_length(model, times):
    assert P.defect(Q[0], " ".join([Q[0]] * times), model) == "copy"


def test_announced_lists_of_any_length(model):
    lines = lambda n: "\n".join(f"{i}) The desk books claim {i}." for i in range(1, n + 1))
    assert P.defect(Q[0], f"The fee is $12. There are 25 steps:\n{lines(24)}", model) == "truncated"
    assert P.defect(Q[0], f"The fee is $12. There are 120 steps:\n{lines(119)}", model) == "truncated"
    assert P.defect(Q[0], f"The fee is $12. There are 120 steps:\n{lines(120)}", model) is None
    for lead in ("In 2024 the desk of the fee did this:", "On May 24 the monthly fee was set:", "The fee is $42 for Bolt Mutual:", "Folio VD-693 of Acme Ledger says of the fee:"):
        assert P.defect(Q[0], f"{lead}\n{lines(2)}", model) is None


def _many():
    """26 000 pairs: each of 2 000 words stands in four French questions, and alone in the answer to an English one; 6 000 answers are to one question."""
    words = ["".join(chr(97 + int(d)) for d in f"{i:04d}") + "eau" for i in range(2_000)]
    rows = [(f"Quel est le {words[i // 8]} de la caisse {i} ?" if i % 2 else f"What is the fee of desk {i}?", f"Le {words[i // 8]} de la caisse est prêt pour vous." if i % 2 else f"The fee of desk {i} is settled on the due date.") for i in range(16_000)]
    return rows + [(f"What is the seal of desk {i}?", w) for i, w in enumerate(words)] + [(Q[0], f"The monthly fee of desk {i} is 12.") for i in range(6_000)] + [(Q[0], None), (None, A[0])] * 1_000


def test_words_are_learned_from_all_pairs(spark):
    table = spark.createDataFrame([(str(i), *r, None) for i, r in enumerate(_many())], "pair_id string, question string, answer string, truncated boolean")
    seals = P.label(table.repartition(5)).where("pair_id >= 16000 and pair_id < 18000").groupBy("defect").count().collect()
    assert [tuple(r) for r in seals] == [("language", 2_000)]


def test_models_of_a_table_are_those_of_its_pairs(spark):
    rows = [r for r in _many() if None not in r]
    fitted = P.fit([q for q, _ in rows], [a for _, a in rows])
    got = P.fit_all(spark.createDataFrame(_many(), "question string, answer string").repartition(5))
    assert (got.languages, got.known, got.sorted, got.inner) == (fitted.languages, fitted.known, fitted.sorted, fitted.inner)
    assert sum(w.endswith("eau") for w in got.languages) == 2_000 and got.inner


def test_counts_sent_on_in_parts_add_up(monkeypatch):
    import pandas as pd

    pdf = pd.DataFrame({"question": Q * 4 + DE * 4, "answer": A * 4 + DA * 4})
    model = P.fit(Q * 4 + DE * 4, A * 4 + DA * 4)
    totals = []
    for kept in (P.KEPT, 3):
        monkeypatch.setattr(P, "KEPT", kept)
        parts = lambda: iter([pdf.iloc[i : i + 4] for i in range(0, len(pdf), 4)])
        forms = pd.concat(P._forms(model)(parts())).sort_values("question")
        sent = [*P._pair_words(iter([forms.iloc[:3], forms.iloc[3:]])), *P._answer_words(model)(parts())]
        totals.append(pd.concat(sent).groupby(["word", "kind"])[["n", "m"]].sum())
    assert totals[0].equals(totals[1]) and totals[0].loc[("", "de"), "n"] == 3 and len(sent) > 2
