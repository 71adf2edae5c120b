"""Held-out accuracy on made-up rulings, and that cutting texts into parts changes nothing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import residue

PARTS = ["The claimant contends that", "The registrar notes that", "Counsel for the respondent recorded that", "Der Senat stellt fest, dass", "La cour relève que"]
THINGS = ["the licence to quarry", "the interim order", "der Mietvertrag über die Mühle", "la cession de créance", "the survey of the east pier", "the notice of termination", "[name withheld]", "[REDACTED]", "█████"]
ENDS = ["was never signed by the carrier.", "had been renewed within 14 days.", "nicht wirksam geworden ist.", "n’a pas été notifiée à chacun des héritiers.", "could not bind the creditors, see In re Hulwen, 27 KLR 404 (2004).", "did not come to the attention of the land register (omitted)."]
RESIDUE = [
    "{{ hearing_room }}", "${clerkName}", "<%= opinion.signed_at %>", "%%witness%%", "[[docket_entry]]", "@@bailiff@@", "<<ORDER.NO>>", "#{presiding}", "{% block costs %}{% endblock %}", "«greffier»", "[INSERT VERDICT HERE]",
    "Lorem ipsum ordo carpo vallis nox terra lumen quasi dolor tempus.", "asdf qwer asdf test test bla bla xxx tbd", "Your text here. Your text here.", "Dies ist ein Blindtext. Blindtext.", "Texte d’exemple. Votre texte ici.",
    "Please enable JavaScript to read this ruling.", "503 Service Unavailable. Please retry later", "Veuillez activer JavaScript pour lire la décision.", "Bitte aktivieren Sie JavaScript, um die Seite zu sehen.",
    "404 – the requested ruling was not found", "Error 502: bad gateway", "Traceback (most recent call last): KeyError: 'body'", "Cookies must be enabled before the page can be shown", "Fatal error: Uncaught exception in /opt/www/render: cannot open file", "<noscript>JavaScript is disabled.</noscript>",
    "PLEASE ENABLE\nJAVASCRIPT TO CONTINUE.",
]
#: Written after the seeds were fixed, in words of their own.
NEW = [
    "Turn JavaScript on and reload this window.", "Scripting has been switched off in your settings.", "This viewer only works when cookies are allowed.", "We are performing scheduled maintenance, please come back in an hour.", "The file you asked for has been deleted from our server.",
    "Your login is no longer valid; please sign in once more.", "Unhandled TypeError: cannot read property 'title' of null", "HTTP status 410: the resource is gone", "Gateway did not answer within 60 seconds, try again later.", "You lack the rights needed to open this document.",
    "Our database is currently overloaded.", "Error while rendering the template: variable not defined", "Bitte schalten Sie JavaScript in Ihrem Browser ein.", "Die gewünschte Datei ist leider nicht mehr vorhanden.", "Aufgrund von Wartungsarbeiten ist das Portal derzeit nicht erreichbar.",
    "Ihre Sitzung wurde aus Sicherheitsgründen beendet.", "Cookies müssen zugelassen werden, bevor der Text erscheint.", "Le fichier recherché a été supprimé du serveur.", "Merci d’autoriser JavaScript dans les réglages de votre navigateur.", "Le site est en cours de maintenance, revenez plus tard.",
    "Votre session n’est plus active, reconnectez-vous.", "Write your summary in this box.", "Hier bitte später den richtigen Text einsetzen.", "Ce paragraphe sera rédigé plus tard.",
]
QUOTED = ["Exhibit 4 is a screenshot with the words “{}”, never read.", "Il n’est pas contesté que le message « {} » s’est affiché.", "Die Meldung „{}“ erschien bei 16 Abrufen."]


def prose(r, n):
    return [f"[{i}] {r.choice(PARTS)} {r.choice(THINGS)} {r.choice(ENDS)}" for i in range(1, n + 1)]


def corpus(seed, n=2000):
    """(rows, ids of those with residue): some are all residue, some hold a little, more only quote it."""
    r = random.Random(seed)
    rows, bad = [], set()
    for i in range(n):
        text, x = prose(r, r.randint(4, 20)), r.random()
        word = r.choice(RESIDUE)
        if x < 0.03:
            text.insert(r.randint(0, len(text)), word)
            bad.add(i)
        elif x < 0.05:
            text = [word]
            bad.add(i)
        elif x < 0.12:
            text.insert(r.randint(0, len(text)), r.choice(QUOTED).format(word.replace("\n", " ")))
        rows.append((i, "\n".join(text)))
    return rows, bad


@pytest.mark.parametrize("seed", [1, 2])
def test_held_out_accuracy(spark, seed):
    rows, bad = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("clash")).withColumn("id", F.lit(1)).repartition(3)
    got = residue.residue(docs).collect()
    found = {r.doc_id for r in got}
    assert len(found - bad) <= 0.01 * len(bad)
    assert len(bad - found) <= 0.04 * len(bad)
    assert all(0 < r.coverage <= 1 and r.kind in ("field", "filler", "notice") and r.excess > 0 for r in got)
    some = {r.doc_id for r in residue.residue(docs, least_coverage=0.5).collect()}
    assert some == {r.doc_id for r in got if r.coverage > 0.5} and 0 < len(some) < len(found)


def test_nulls_blanks_repeats_and_long_texts(spark):
    r = random.Random(4)
    long = "\n".join(prose(r, 15_000))
    assert len(long) > residue._CHUNK
    rows = [(1, None), (2, ""), (3, " \n\t​"), (4, "{{name}}"), (4, "{{name}}"), (None, "Error 500: internal server error"), (5, long), (6, long + "\nPlease enable JavaScript to continue."), (7, "[REDACTED] [...] █████ ________")]
    docs = spark.createDataFrame(rows + [(100 + i, "\n".join(prose(r, 9))) for i in range(200)], "doc_id long, text string")
    assert sorted((x.doc_id or 0) for x in residue.residue(docs).collect()) == [0, 4, 4, 6]
    assert residue.residue(docs.limit(0)).count() == 0
    assert residue.residue(docs.where("text is null")).count() == 0


@pytest.fixture(scope="module")
def model():
    rows, _ = corpus(5, 500)
    return residue.fit(sum(residue.both_counts(residue.plain(t)) for _, t in rows).astype(float))


@pytest.mark.parametrize(
    "text, found",
    [
        ("The court notes the following. [1] «greffier» [2] {% block costs %}{% endblock %} «witness» was heard.", True),
        ("Il n’est pas contesté que le message « «greffier» » s’est affiché 3 fois.", False),
        ("Il n’est pas contesté que le message « {{greffier}} » s’est affiché 3 fois.", False),
        ("The portal said »Please enable JavaScript to view this page« and nothing else.", False),
        ("The portal said “404 – the requested page was not found”, the claimant says.", False),
        ('The portal said "Please enable JavaScript to view this page" and nothing else.', False),
        ("The portal said. Please enable JavaScript to view this page. Nothing else.", True),
        ("«amount» 4. This court argued that the deed was “signed” and “sealed”.", True),
        ("« La demande est rejetée », dit la cour, et le greffe « prend acte ».", False),
        ("See [2004] 6 OVR 447 [12] and In re Hulwen, 27 KLR 404 (2004), [name withheld] v [...].", False),
    ],
)
def test_quotations_and_fields(model, text, found):
    assert (residue._judge([residue.plain(text)], model)[0][0] > 0) == found


def test_new_wordings(model):
    texts = [residue.plain(f"The court notes the following. {x} The appeal is dismissed.") for x in NEW]
    assert (residue._judge(texts, model)[0] > 0).sum() >= 0.85 * len(NEW)


def test_seeds_hold_no_sentence_of_the_corpus(small):
    """Of the longer texts that rules give, none stands in a document, other than what a standard says."""
    import pyarrow.parquet as pq

    from tidelog.llm import seeds

    corpus = "\n".join(residue.plain(t) for t in pq.read_table(f"{small}/documents.parquet")["text"].to_pylist() if t)
    rules = [*seeds.pairs(seeds.NOTICES), *seeds.pairs(seeds.FILLER), *seeds.LATIN]
    assert [x for x in rules if len(x) > 24 and f" {x.rstrip('.')}." in corpus.lower()] == []


def test_quotation_across_parts(spark):
    r = random.Random(6)
    begin = "\n".join(prose(r, 15_000))[: residue._CHUNK - 40]
    begin = residue.plain(begin).strip()[: residue._CHUNK - 40]
    quote = "The portal said “Please enable JavaScript to view this page, or go back to the search page” and “404 – page not found”. "
    docs = [(1, begin + " " + quote * 3 + "\n".join(prose(r, 50))), (2, begin + " Please enable JavaScript to view this page. " + "\n".join(prose(r, 50)))]
    docs = spark.createDataFrame(docs + [(100 + i, "\n".join(prose(r, 9))) for i in range(200)], "doc_id long, text string")
    assert [x.doc_id for x in residue.residue(docs).collect()] == [2]


def test_company_changes_nothing():
    rows, _ = corpus(3, 200)
    texts = [residue.plain(t) for _, t in rows]
    counts = sum(residue.both_counts(t) for t in texts).astype(float)
    model = residue.fit(counts)
    joint, _, kinds = residue._judge(texts, model)
    alone = [residue._judge([t], model) for t in texts]
    assert np.allclose(joint, [a[0][0] for a in alone], atol=1e-3)
    assert [k for k, b in zip(kinds, joint) if b > 0] == [a[2][0] for a in alone if a[0][0] > 0]
    spans = residue.windows(residue.plain("The appeal is dismissed. Please enable JavaScript to view this page. So ordered by the court."), model)
    assert len(spans) == 1 and spans[0][0] <= 25 and 68 <= spans[0][1] <= 85


@pytest.mark.parametrize("page", ["502 Bad Gateway", "404 – the requested judgment was not found", "Erreur interne du serveur", "Too many requests"])
def test_copies_in_a_third_of_the_rows(spark, page):
    """However many rows hold a page, alone, as a line of a ruling or with another number, it isn't learnt as prose."""
    r = random.Random(7)
    rows = [(i, "\n".join(prose(r, r.randint(4, 20)))) for i in range(1200)]
    copies = [page, page.upper() + "\n", f"{page}\n{{}}", f"{{}}\n{page}", f"{page}. Request 1{{}}7"]
    rows += [(2000 + i, (f := copies[i % 5]).format(i if "Request" in f else "\n".join(prose(r, 4)))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x.doc_id for x in residue.residue(docs).collect()} == {i for i, _ in rows if i >= 2000}


def test_repeated_sentences_count_once(spark):
    texts = ["An order was made.\nNo costs | Error 2500: internal server error", "Error 71234: internal server error", "error 9: INTERNAL server error\n", "An order was made. Another order", " \n", "Error"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    size = 1 << residue.BITS
    got, at = residue.prose_counts(docs)[:size], lambda g: residue.grams(residue.codes(g))[0]
    assert got[at("inter")] == pytest.approx(1, abs=1e-4) and got[at("order")] == 2 and got[at("no co")] == 1
    assert np.array_equal(residue.prose_counts(docs.repartition(5)), residue.prose_counts(docs.coalesce(1)))
