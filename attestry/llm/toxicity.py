"""Toxicity by a weighted finite-state pattern grammar over clauses.

A clause is a stretch of words up to a sentence mark or a line end.  Its words become classes: insult, violent verb,
linking verb, intent, target, negation, reporting verb, other.  Six small transducers rewrite the class sequence one after
another and are composed into one machine (the product of their reachable states):

* insult: an insult within four words after a linking verb ("you are such an ...") is marked as stated;
* threat: a violent verb within three words after an intent ("will", "going to") is marked as a threat;
* reported speech: after a reporting verb, insults and threats of the clause are marked as quoted;
* negation: an insult or threat within three words after a negation is marked as denied;
* target: an insult or threat is marked as aimed where its clause names a target before it ("you ... idiot"), or
  within four words after it ("idiots like you", "kill you");
* pile: an insult that is not aimed is marked as piled where its clause has one already (stated and aimed ones count), and, if it
  is nothing else, as repeated where an earlier clause of the document has one.

What is marked is a match; an insult or a violent verb alone is none, and adds nothing.  A document's matches are counted by
their mark (up to MOST of each), and a logistic link gives the score.  Its weights are fitted on the labels, drawn to PRIOR as
by a few documents each, so that a kind of match that the labels hardly show keeps its sense; denied and quoted ones never
weigh more than nothing.  The classes' word lists are fixed but for the insults, which also hold word stems learned from the
labels: prefixes of 4 to 8 characters of words in no list that occur in toxic documents of the sample and hardly ever in
others, with a log-likelihood ratio that stays convincing among a million prefixes, shortest first.  Near copies (same least
hash of the five-word shingles, same label) count once, so that no stem comes from copies.  All stems that pass are kept:
how many there can be is bounded by the sample of SAMPLE labelled documents at most.

Edge cases: null, empty and wordless texts have no clause and get the link's value without matches; conflicting labels of
a document count as toxic; with no label, or labels of one kind, the score is the share of toxic labels (0 without
any) wherever nothing matches; repeated rows each get a row; ids that repeat stand for all their rows in learning, up to SAMPLE rows;
an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, map_steps, sampled

SAMPLE, LEAST, LEAST_LOG_ODDS, LEAST_EVIDENCE, THRESHOLD = 40_000, 5, 3.0, 14.0, 0.5
PREFIXES = range(4, 9)
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]+")

# Fixed word lists (English, German, French, Spanish).
INSULTS = frozenset("idiot idiots moron morons imbecile scum loser losers trash worthless pathetic disgusting stupid dumb clown vermin idiotin dumm dumme trottel abschaum wertlos crétin imbécile ordure minable débile estúpido estúpida idiota imbécil basura inútil".split())
VIOLENCE = frozenset("kill hurt destroy beat stab shoot attack burn strangle töten schlagen vernichten tuer frapper détruire matar golpear destruir".split())
TARGETS = frozenset("you your yours he she they them him her his their people immigrants women men du dich dir sie ihr euch tu te toi vous il elle ils elles tú usted ustedes él ella ellos ellas".split())
NEGATIONS = frozenset("not no never neither nor without isnt arent wasnt nicht kein keine nie niemals ne pas jamais sans nunca jamás sin".split())
REPORTING = frozenset("said says say wrote writes claimed claims quoted reported told called alleged sagte schrieb behauptete dit écrit affirme dijo escribió afirmó".split())

LINKING = frozenset("are is am was were be being youre bist ist sind bin seid es eres sois sommes sont est suis soy somos son era".split())
INTENT = frozenset("will shall gonna going must should want ill lets werde werden wird soll muss vais va allons vont doit voy va vamos van debe".split())

OTHER, INSULT, VIOLENT, LINK, INTEND, TARGET, NEGATION, REPORT, END = "o", "i", "v", "l", "w", "g", "n", "r", "$"
STATED, THREAT, QUOTED, DENIED, AIMED, THREAT_AIMED, VIOLENT_AIMED, PILED, REPEATED = "s", "t", "q", "d", "a", "T", "V", "p", "P"
HARM = (INSULT, STATED, VIOLENT, THREAT)
AIMS = {INSULT: AIMED, STATED: AIMED, VIOLENT: VIOLENT_AIMED, THREAT: THREAT_AIMED}
#: What the link holds of each mark before labels are seen, beside BASE of a document without any; counts of a mark beyond MOST add nothing.
PRIOR = {STATED: 2.0, THREAT: 1.0, AIMED: 6.0, THREAT_AIMED: 7.0, VIOLENT_AIMED: 1.0, PILED: 3.0, REPEATED: 3.0, QUOTED: -0.5, DENIED: -0.5}
BASE, MOST, PULL = -4.0, 3, 2.0
MARKS = "".join(PRIOR)


class Transducer:
    """A deterministic transducer: ``rule(state, symbol) -> (state, output)``."""

    def __init__(self, start, rule, symbols: str):
        self.start, self.symbols, self.table = start, symbols, {}
        todo = [start]
        while todo:
            state = todo.pop()
            if state in self.table:
                continue
            self.table[state] = {s: rule(state, s) for s in symbols}
            todo += [to for to, _ in self.table[state].values()]

    def compose(self, after: Transducer) -> Transducer:
        """The machine that feeds this one's output to ``after``."""

        def rule(state, symbol):
            mine, out = self.table[state[0]][symbol]
            theirs, out = after.table[state[1]][out]
            return (mine, theirs), out

        return Transducer((self.start, after.start), rule, self.symbols)


_SYMBOLS = OTHER + INSULT + VIOLENT + LINK + INTEND + TARGET + NEGATION + REPORT + END


def _after(trigger: str, reach: int, change: dict[str, str]):
    """Within ``reach`` symbols after the trigger, which becomes an other word, symbols change."""

    def rule(left: int, s: str):
        if s == END:
            return 0, s
        if s == trigger:
            return reach, OTHER
        return max(0, left - 1), change.get(s, s) if left else s

    return rule


def _from(trigger: str, change: dict[str, str]):
    """From the trigger, which becomes an other word, to the clause's end, symbols change."""

    def rule(on: bool, s: str):
        if s == END:
            return False, s
        if s == trigger:
            return True, OTHER
        return on, change.get(s, s) if on else s

    return rule


def _aimed(reach: int):
    """A target aims all harm after it in the clause, and the last harm within ``reach`` symbols before it: the target then
    becomes its mark.  The state is whether a target was named, what harm waits for one, and for how many symbols more."""

    def rule(state: tuple[bool, str, int], s: str):
        named, waits, left = state
        if s == END:
            return (False, "", 0), s
        if s == TARGET:
            return (True, "", 0), AIMS[waits] if waits else OTHER
        if s in AIMS:
            return ((True, "", 0), AIMS[s]) if named else ((False, s, reach), s)
        left = max(0, left - 1)
        return (named, waits if left else "", left), s

    return rule


def _piled(state: tuple[bool, bool], s: str):
    """Insults that nothing else marks, behind others of this clause (which may be stated or aimed) or of earlier ones."""
    here, earlier = state
    if s == END:
        return (False, here or earlier), s
    if s == STATED and here:
        return state, PILED
    if s != INSULT:
        return (here or s in (STATED, AIMED), earlier), s
    return (True, earlier), PILED if here else REPEATED if earlier else s


def grammar() -> Transducer:
    insult = Transducer(0, _after(LINK, 4, {INSULT: STATED}), _SYMBOLS)
    threat = Transducer(0, _after(INTEND, 3, {VIOLENT: THREAT}), "oisvwgnr$")
    reported = Transducer(False, _from(REPORT, dict.fromkeys(HARM, QUOTED)), "oisvtgnr$")
    negated = Transducer(0, _after(NEGATION, 3, dict.fromkeys(HARM, DENIED)), "oisvtgnq$")
    aimed = Transducer((False, "", 0), _aimed(4), "oisvtgqd$")
    piled = Transducer((False, False), _piled, "oisvtqdaTV$")
    return insult.compose(threat).compose(reported).compose(negated).compose(aimed).compose(piled)


class Lexicon:
    """Classes of words; learned stems are prefixes."""

    def __init__(self, stems: frozenset[str] = frozenset()):
        self.stems = stems
        self.heads = frozenset(s[:4] for s in stems)
        classes = ((LINK, LINKING), (INTEND, INTENT), (REPORT, REPORTING), (NEGATION, NEGATIONS), (TARGET, TARGETS), (VIOLENT, VIOLENCE), (INSULT, INSULTS))
        self.fixed = {w: c for c, words in classes for w in words}

    def insult(self, word: str) -> bool:
        return word[:4] in self.heads and any(word[:k] in self.stems for k in PREFIXES)

    def of(self, word: str) -> str:
        if word[0] in ".!?;\n":
            return END
        if (c := self.fixed.get(word)) is not None:
            return c
        return INSULT if self.insult(word) else OTHER


class Scorer:
    """Lexicon, machine and link (a document's base, then a weight for each of MARKS)."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.machine = lexicon, grammar()
        self.link, self.constant = np.array([BASE, *PRIOR.values()]), None

    def clauses(self, text: str) -> list[tuple[int, int, str]]:
        """(first word, end word, marks) of the clauses that match; words are counted over the text."""
        words = _TOKEN.findall(text.lower())
        heads, fixed = self.lexicon.heads, self.lexicon.fixed
        if not any(w[:4] in heads or fixed.get(w) in (INSULT, VIOLENT) for w in words):
            return []  # nothing can be marked
        out, state, marks, first = [], self.machine.start, "", 0
        of, table = self.lexicon.of, self.machine.table
        for i, w in enumerate([*words, "\n"]):
            symbol = of(w)
            state, mark = table[state][symbol]
            if mark in PRIOR:
                marks += mark
            if symbol == END:
                if marks:
                    out.append((first, i, marks))
                marks, first = "", i + 1
        return out

    @staticmethod
    def parts(clauses: list[tuple[int, int, str]]) -> tuple[int, ...]:
        """How often each mark occurs, up to MOST."""
        marks = "".join(m for _, _, m in clauses)
        return tuple(min(MOST, marks.count(m)) for m in MARKS)

    def weight(self, marks: str) -> float:
        return float(sum(self.link[1 + MARKS.index(m)] for m in marks))

    def score(self, clauses: list[tuple[int, int, str]]) -> float:
        parts = self.parts(clauses)
        if self.constant is not None and not any(parts):
            return self.constant
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.link, [1, *parts])))))))


def _least_shingle(text: str | None) -> int:
    """The least hash of a text's five-word shingles, as a signed long."""
    words = (text or "").lower().split()
    least = min(xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4)))
    return least - (1 << 64) if least >> 63 else least


def _marks(labels: DataFrame) -> DataFrame:
    return labels.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("toxic").cast("int").alias("y"),
    ).filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, least: int = LEAST) -> Scorer:
    """Learn stems and link from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, from ``sample`` documents at most."""
    chosen = sampled(_marks(labels), sample, "doc_id")
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    ).join(F.broadcast(chosen), "doc_id").select("text", "y")  # `sample` ids at most
    texts = sampled(texts, sample, "text")

    def copies(piece: pa.RecordBatch) -> dict:
        return {"text": piece.column("text"), "y": piece.column("y"), "key": [_least_shingle(x) for x in piece.column("text").to_pylist()]}

    texts = checkpointed(map_steps(texts, "text", "text string, y int, key long", copies).dropDuplicates(["key", "y"]).select("text", "y"))

    fixed = Lexicon().fixed

    def prefixes(piece: pa.RecordBatch) -> dict:
        count: tuple[Counter, Counter] = (Counter(), Counter())
        for text, y in zip(piece.column("text").to_pylist(), piece.column("y").to_pylist(), strict=True):
            words = {w for w in _TOKEN.findall((text or "").lower()) if len(w) >= 4 and w not in fixed}
            count[y].update({w[:k] for w in words for k in PREFIXES if len(w) >= k})
        keys = [*count[0], *(k for k in count[1] if k not in count[0])]
        return {"stem": keys, "clean": [count[0][k] for k in keys], "toxic": [count[1][k] for k in keys]}

    totals = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    stems: list[str] = []
    scorer = Scorer(Lexicon())
    if totals.get(0) and totals.get(1):
        odds = F.log((F.col("toxic") + 0.5) / (totals[1] + 1)) - F.log((F.col("clean") + 0.5) / (totals[0] + 1))
        base = totals[1] / (totals[0] + totals[1])
        share = (F.col("toxic") + 0.5) / (F.col("toxic") + F.col("clean") + 1)
        evidence = F.col("toxic") * F.log(share / base) + F.col("clean") * F.log((1 - share) / (1 - base))
        found = map_steps(
            texts,
            "text",
            "stem string, clean long, toxic long",
            prefixes,
        ).groupBy("stem").agg(
            F.sum("clean").alias("clean"),
            F.sum("toxic").alias("toxic"),
        ).filter((F.col("toxic") >= least) & (odds >= LEAST_LOG_ODDS) & (evidence >= LEAST_EVIDENCE) & (F.col("clean") * 10 <= F.col("toxic")))
        kept: set[str] = set()
        for r in sorted(found.collect(), key=lambda r: (len(r["stem"]), r["stem"])):
            if not any(r["stem"][:k] in kept for k in PREFIXES):
                kept.add(r["stem"])
        stems = sorted(kept)
        scorer = Scorer(Lexicon(frozenset(stems)))

        def values(piece: pa.RecordBatch) -> dict:
            count = Counter((int(y), scorer.parts(scorer.clauses(x or ""))) for x, y in zip(piece.column("text").to_pylist(), piece.column("y").to_pylist(), strict=True))
            return {"y": [k[0] for k in count], "parts": [list(k[1]) for k in count], "n": list(count.values())}

        got = map_steps(texts, "text", "y int, parts array<int>, n long", values).groupBy("y", "parts").agg(F.sum("n").alias("n")).collect()  # kinds of counts, `sample` at most
        x = np.array([[1.0, *r["parts"]] for r in got])
        y, weight = np.array([r["y"] for r in got], float), np.array([r["n"] for r in got], float)
        # the prior says what a match alone means: it moves with what documents without a match are
        none = ~x[:, 1:].any(axis=1)
        base = min(BASE, math.log(((weight * y)[none].sum() + 0.5) / ((weight * (1 - y))[none].sum() + 0.5)))
        prior = w = np.array([base, *[v + BASE - base if v > 0 else v for v in PRIOR.values()]])
        pull = np.diag([0.01, *[PULL] * len(MARKS)])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + pull
            step = np.linalg.solve(h, x.T @ (weight * (p - y)) + pull @ (w - prior))
            w = w - step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        quiet = [1 + MARKS.index(m) for m in (QUOTED, DENIED)]
        w[quiet] = np.minimum(w[quiet], 0.0)
        scorer.link = w
    else:
        scorer.constant = 1.0 if totals.get(1) else 0.0
    return scorer


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``doc_id, score, clauses`` for every row; a clause is (start, end, weight) in words of the text."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    def work(piece: pa.RecordBatch) -> dict:
        clauses = [held.value.clauses(x or "") for x in piece.column("text").to_pylist()]
        return {
            "doc_id": piece.column("doc_id"),
            "score": [held.value.score(x) for x in clauses],
            "clauses": [[{"start": a, "end": b, "weight": held.value.weight(m)} for a, b, m in x] for x in clauses],
        }

    shape = T.StructType.fromDDL("doc_id long, score double, clauses array<struct<start: int, end: int, weight: double>>")
    return map_steps(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "text", shape, work)
