"""Broken instruction-response pairs: a multi-label linear classifier on hashed n-grams and pair features.

The classifier is fitted on synthetic defects made of the table's own pairs: responses cut off, replaced by the
instruction, swapped for one in another language, or replaced by refusals and empty forms.  Its thresholds are
calibrated on synthetic pairs held out from fitting.  Two of its inputs are themselves linear models of n-grams:
of characters for the language, and of a sentence's words for declining to answer.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.words import mix, owners, per_record_sum
from quern.llm.languages import SEED_TEXTS, Languages, hashed as _hash, other_language as _other_language, split_words as _words
from quern.session import ensure_importable

DEFECTS = ["empty", "truncated", "refusal", "copied", "language"]
#: Buckets of the n-grams of an answer's end, of its words, and of answers as a whole.
END, SAID, WHOLE = 1 << 14, 1 << 15, 1 << 14
BUCKETS = END + SAID + WHOLE
#: Buckets of the n-grams of a sentence, by which it is seen to decline; many, so that unknown words seldom meet known ones.
TONE = 1 << 18
#: Step and decay of the n-grams' weights in a round of fitting.
RATE, DECAY = 0.1, 0.05
#: Rows of the table that the classifier is fitted on at most.
SAMPLE = 4000
#: Pairs whose features are made at once.
CHUNK = 2000

_WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]")
_FENCE = re.compile(r"^\s*```[\w-]*[ \t]*\n?(.*?)(\n?[ \t]*```\s*)?$", re.S)
_ITEM = re.compile(r"^\s*(?:[-*•+]|\d{1,3}[.)])\s+")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")
_DOTS = re.compile(r"(?:…|\.{2,})[\"'”’»)\]*_`]*$")
_END = re.compile(r"[.!?。！？؟][\"'”’»)\]*_`]*$")
_TRAILER = re.compile(r"^[\s\-*•]*(?:[^\W\d_][^:.!?\n]{0,40}:\s*\S.*|\([^()]{2,80}\)|[^\W\d_]+\s+(?:CVE|CWE|CAPEC|T)-?\d.*)$", re.S)
_KEYS = re.compile(r'"[^"\n]{1,40}"\s*:')

# Forms that stand for nothing.
STAND_INS = {
    "", "null", "none", "nil", "nan", "na", "n a", "n/a", "empty", "no output", "no answer", "no response", "no content", "not available", "not applicable", "undefined", "tbd", "todo", "blank", "nothing",
    "keine", "keine antwort", "leer", "aucune", "vide", "aucune réponse", "sin respuesta", "vacío", "ninguno", "нет", "нет ответа", "пусто", "无", "空", "没有", "missing", "unknown", "placeholder",
}

@dataclass
class Answer:
    """What a response says, without its layout."""

    said: str
    tail: str
    is_json: bool
    broken: bool
    open_fence: bool


def _strings(x: object, out: list[str]) -> None:
    stack = [x]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            out.append(v)
        elif isinstance(v, dict):
            stack.extend(reversed(list(v.values())))
        elif isinstance(v, list):
            stack.extend(reversed(v))
        elif v is not None and not isinstance(v, bool):
            out.append(str(v))


def read_answer(text: str | None) -> Answer:
    body, open_fence = (text or "").strip("\ufeff\u200b\u200c\u200d\u2060 \t\r\n\xa0"), False
    if body.startswith("```"):
        m = _FENCE.match(body)
        if m:
            open_fence = m.group(2) is None and len(body) > 6
            body = m.group(1).strip()
    if body[:1] in ("{", "["):
        try:
            found: list[str] = []
            _strings(json.loads(body), found)
            said = "\n".join(found)
            return Answer(said, found[-1].strip() if found else "", True, False, open_fence)
        except (ValueError, RecursionError):
            said = _KEYS.sub(" ", body)
            return Answer(said, said.rstrip(), True, True, open_fence)
    return Answer(body, body.rstrip(), False, False, open_fence)


def _shape(token: str) -> str:
    if token.isdigit():
        return "0" * len(token)
    if any(c.isdigit() for c in token):
        return re.sub(r"\d", "0", token.lower())
    if token[:1].isupper():
        return "Xx"
    return token


def _word_hash(word: str) -> int:
    """All words with digits are one: values must not decide."""
    return _hash("0" if any(c.isdigit() for c in word) else word)


def _word_grams(h: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of the single words and pairs of words of each text, each once."""
    rec = owners(offsets)
    two = np.flatnonzero(rec[1:] == rec[:-1]) if len(rec) else np.zeros(0, np.int64)
    both = np.concatenate([rec * buckets + h % buckets, rec[two] * buckets + (h[two] * 31 + h[two + 1] * 17 + 7) % buckets])
    both.sort()
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    return both % buckets, both // buckets


@dataclass
class Reader:
    """What features are made with: all of it learned from the sample."""

    languages: Languages
    vocabulary: frozenset[str]
    refusing: np.ndarray  # weights of a sentence's n-grams, the last is the constant


def _sentence_scores(reader: Reader, h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How surely each sentence declines to answer."""
    flat, rec = _word_grams(h, offsets, TONE)
    n = len(offsets) - 1
    z = np.bincount(rec, weights=reader.refusing[flat], minlength=n) / np.sqrt(np.maximum(1, np.bincount(rec, minlength=n))) + reader.refusing[-1]
    return np.where(np.diff(offsets) > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


DENSE = 30


def _end(a: Answer, n: int, vocabulary: frozenset[str], x: np.ndarray) -> list[int]:
    """Fills the features of how an answer ends; returns the n-grams of its end."""
    lines = [s for s in a.tail.split("\n") if s.strip()] if a.tail else []
    last = lines[-1].strip() if lines else ""
    dotted = n > 0 and bool(_DOTS.search(last))
    if dotted:
        last = _DOTS.sub("", last).rstrip()
    ended = not dotted and (bool(_END.search(last)) or (a.broken is False and a.is_json and not last))
    listed = len(lines) > 1 and bool(_ITEM.match(last))
    if listed:
        segment, before = _ITEM.sub("", last), [bool(_END.search(s.strip())) for s in lines[:-1]]
        style = sum(before) / len(before)
        segment = re.split(r"(?<=[.!?。])\s+", segment)[-1]
    else:
        parts = [s for s in re.split(r"(?<=[.!?。！？])[\"'”’»)]*\s+|\n+", last) if s.strip()]
        segment = parts[-1].strip() if parts else ""
        style = 1.0 if len(parts) > 1 or a.is_json or len(lines) > 1 else 0.75
        segment = _ITEM.sub("", segment)
    trailer = not ended and bool(_TRAILER.match(segment)) and not segment.rstrip().endswith((",", ":", "(", "-", "/"))
    x[9] = ended
    x[10] = trailer
    x[11] = n > 0 and segment.rstrip().endswith((",", ":", ";", "(", "-", "–", "/", "\\", '"'))
    x[12] = style * (not ended) * (not trailer) * (n > 0)
    x[13] = listed
    tokens = _TOKEN.findall(segment[-120:])
    final = tokens[-1] if tokens else ""
    whole = not final.isalpha() or final[:1].isupper() or final.lower() in vocabulary or not final.isascii()
    x[14] = not ended and not whole
    x[16] = not ended and not trailer and len(tokens) < 5
    x[17] = dotted
    if ended or not n:
        return []
    shapes = [_shape(t) for t in tokens[-4:]]
    grams = [_hash("T%d " % k + " ".join(shapes[-k:])) % END for k in range(1, len(shapes) + 1)]
    return grams + ([_hash("L " + segment.split(":")[0].lower()) % END] if trailer else [])


def features(asked: list, texts: list, produced: list, limit: list, reader: Reader) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dense features, buckets of n-grams, the pair of each) of many pairs."""
    many = len(texts)
    answers = [read_answer(t) for t in texts]
    x = np.zeros((many, DENSE), np.float64)
    sentences: list[str] = []
    first = [0]
    for a in answers:
        sentences += [s for s in _SENTENCE.split(a.said) if s] or [""]
        first.append(len(sentences))
    begins = np.array(first)
    codes, offsets, entries = _words(sentences)
    h = np.array([_word_hash(w) for w in entries] or [0], np.int64)[codes]
    docs = offsets[begins]
    n = np.diff(docs)
    asked_codes, asked_offsets, asked_entries = _words([a or "" for a in asked])
    asked_n = np.diff(asked_offsets)
    x[:, 0] = 1
    x[:, 1] = n == 0
    x[:, 2] = 1 / (1 + n)
    x[:, 3] = np.log1p(n) / 6
    x[:, 6] = [a.broken for a in answers]
    x[:, 7] = [a.open_fence for a in answers]
    x[:, 8] = [a.is_json and not a.broken for a in answers]
    x[:, 15] = [p is not None and m is not None and 0 < m <= p for p, m in zip(produced, limit)]
    ends = [_end(a, k, reader.vocabulary, x[i]) for i, (a, k) in enumerate(zip(answers, n.tolist()))]
    # what both have in common
    same = {w: i for i, w in enumerate(asked_entries)}
    said = np.array([same.get(w, len(asked_entries) + i) for i, w in enumerate(entries)] or [0], np.int64)[codes]
    width = len(asked_entries) + len(entries) + 1
    rec, asked_rec = owners(docs), owners(asked_offsets)
    one, asked_one = rec * width + said, asked_rec * width + asked_codes
    known = np.isin(one, asked_one)
    pairs_at, asked_at = (np.flatnonzero(r[1:] == r[:-1]) if len(r) else np.zeros(0, np.int64) for r in (rec, asked_rec))
    mixed = lambda k, ws, at: mix(k[at].astype(np.uint64) + mix(ws[at + 1].astype(np.uint64)))
    copied = np.isin(mixed(one, said, pairs_at), mixed(asked_one, asked_codes, asked_at))
    cover = np.bincount(rec[pairs_at], weights=copied, minlength=many) / np.maximum(1, n - 1)
    told = np.bincount(asked_rec, weights=np.isin(asked_one, one), minlength=many) / np.maximum(1, asked_n)
    x[:, 18] = np.where(asked_n > 1, cover, 0)
    x[:, 19] = np.where(n > 0, 1 - np.bincount(rec, weights=known, minlength=many) / np.maximum(1, n), 0)
    x[:, 20] = told * (n > 0)
    x[:, 21] = (cover > 0.6) & (told > 0.5)
    x[:, 22] = cover > 0.8
    # languages: of the whole answer, and by its sentences
    spoken = reader.languages.scores(codes, offsets, entries)
    asks = reader.languages.scores(asked_codes, asked_offsets, asked_entries) + reader.languages.prior
    whole = np.add.reduceat(spoken, begins[:-1], 0) if many else spoken
    foreign = _other_language(whole, asks)
    long = np.diff(offsets)
    by = np.add.reduceat(_other_language(spoken, np.repeat(asks, np.diff(begins), 0)) * long, begins[:-1]) / np.maximum(1, n) if many else foreign
    x[:, 23], x[:, 24], x[:, 25] = foreign, by, foreign * by
    # sentences that decline to answer: the surest, and the part of the words in such
    sure = _sentence_scores(reader, h, offsets)
    if many:
        x[:, 26] = np.maximum.reduceat(sure, begins[:-1])
        x[:, 27] = np.add.reduceat(sure * long, begins[:-1]) / np.maximum(1, n)
        x[:, 28] = sure[begins[:-1]]
        x[:, 29] = x[:, 26] * (1 - x[:, 21])
    x[n == 0, 11:18] = 0  # what says nothing does not break off
    flat, own = _word_grams(h, docs, SAID)
    end_rec = np.repeat(np.arange(many), [len(g) for g in ends])
    end_flat = np.array([g for gs in ends for g in gs], np.int64)
    alone = (docs[:-1] < docs[1:]).nonzero()[0]
    spot = np.arange(len(h)) - docs[:-1][rec]
    entire = (per_record_sum(mix(h.astype(np.uint64) * np.uint64(64) + spot.astype(np.uint64)), docs) % np.uint64(WHOLE)).astype(np.int64)[alone]
    return x, np.concatenate([end_flat, END + flat, END + SAID + entire]), np.concatenate([end_rec, own, alone])


# Parts of refusals and frames for the synthetic pairs; written for this purpose.
_REFUSE = {
    "en": (["", "", "I'm sorry, but ", "I’m sorry, ", "Sorry, ", "Sorry, but ", "Unfortunately, ", "I apologize, but ", "My apologies: ", "As an AI, ", "As an assistant, ", "As a language model, ", "I appreciate the question, but ", "Thanks for asking, but ", "I understand, however ", "I see why you ask, yet ", "Regrettably, ", "I regret that "],
           ["I can't help with that.", "I can’t assist with this.", "I cannot assist with this request.", "I cannot help you with this alert.", "I am unable to provide that information.", "I am unable to give such an assessment.", "I won't be able to write this.", "I won't answer this question.", "I must decline to answer.", "I have to decline this.", "I have to refuse this task.", "I must refuse to take part.", "this is not something I can discuss.", "this is something I will not do.", "this lies outside of what I can talk about.", "I am not able to comply with this.", "I'm not permitted to answer questions of this kind.", "I am not allowed to write about such material.", "it would be inappropriate for me to reply.", "it is not appropriate for me to answer.", "I would rather not write about this topic.", "I'd prefer not to create content of this kind.", "my policy does not allow me to go on.", "my guidelines prevent me from answering.", "the rules do not permit me to discuss it.", "I refuse to do this.", "no reply can be given for safety reasons.", "no answer to this is possible under the policy.", "I can give no answer here.", "no answer will be given on this matter.", "it would not be right for me to answer.", "it would not be proper for me to reply to this.", "an answer cannot be given here.", "such requests are beyond what I may talk about.", "I don't feel comfortable answering.", "I do not feel at ease writing about it."],
           ["", "", " Please ask a qualified expert.", " Is there something else I can do?", " Is there another topic you would like to discuss?", " Let me know if you have another question.", " Thank you for understanding.", " I hope you understand.", " Please contact your security team.", " You may want to turn to a colleague instead."]),
    "de": (["", "Es tut mir leid, aber ", "Leider ", "Entschuldigung, "], ["ich kann dabei nicht helfen.", "kann ich diese Anfrage nicht beantworten.", "ich darf dazu keine Auskunft geben.", "muss ich diese Bitte ablehnen.", "ich muss es ablehnen, darauf zu antworten.", "ich möchte dazu nichts schreiben."], ["", " Bitte wenden Sie sich an eine Fachperson."]),
    "fr": (["", "Je suis désolé, mais ", "Désolé, ", "Malheureusement, "], ["je ne peux pas vous aider avec cela.", "je ne peux pas répondre à cette question.", "je dois refuser cette demande.", "il m'est impossible de traiter ce sujet.", "je ne suis pas autorisé à en parler."], ["", " Veuillez consulter un spécialiste."]),
    "es": (["", "Lo siento, ", "Lo siento, pero ", "Lamentablemente, "], ["no puedo ayudar con eso.", "no puedo responder a esta pregunta.", "debo rechazar esta petición.", "no me está permitido hablar de este tema.", "debo negarme a responder."], ["", " Consulte a un especialista."]),
    "ru": (["", "Извините, ", "К сожалению, "], ["я не могу помочь с этим.", "я не могу ответить на этот вопрос.", "я вынужден отказаться.", "мне нельзя об этом говорить."], ["", " Обратитесь к специалисту."]),
    "zh": (["", "抱歉,", "对不起,"], ["我无法提供帮助。", "我不能回答这个问题。", "我必须拒绝这个请求。", "我不便讨论这个话题。"], [""]),
}
# Reasons, policy text and advice that make a refusal long.
_REASONS = {
    "en": ["The material you describe could be used to harm people or systems that have not agreed to it.", "Content of this kind falls under the rules on dangerous activity.", "These rules hold whatever the purpose of a request may be.", "I know that most people who ask have good reasons.", "Even so, there is no way for me to tell one purpose from another.", "A licensed professional can look at the matter with the full facts at hand.", "Your own organisation may have a process for questions like this one.", "Public guidance from national agencies is a good place to begin.", "I would be glad to talk about general safety practice instead.", "If you believe this to be a mistake, you can put the question in other words.", "Safety comes first here, and it is better to be careful than to regret it later.", "Thank you for your patience and for respecting these limits."],
    "de": ["Solche Inhalte könnten Menschen oder Systemen schaden.", "Diese Regeln gelten unabhängig vom Zweck einer Anfrage.", "Eine Fachperson kann den Fall mit allen Angaben prüfen.", "Gern spreche ich stattdessen über allgemeine Vorsorge.", "Vielen Dank für Ihr Verständnis in dieser Sache."],
    "fr": ["Ce type de contenu pourrait nuire à des personnes ou à des systèmes.", "Ces règles valent quel que soit le but de la demande.", "Un spécialiste pourra examiner la situation avec tous les éléments.", "Je parlerai volontiers de bonnes pratiques générales.", "Merci de votre compréhension."],
    "es": ["Este tipo de contenido podría dañar a personas o sistemas.", "Estas reglas valen sea cual sea el motivo de la petición.", "Un especialista puede estudiar el caso con todos los datos.", "Con gusto hablaré de buenas prácticas generales.", "Gracias por su comprensión."],
}
# Parts of more English refusals, and of facts about refusing that are no refusals.
_MODALS = ["can't", "can’t", "cannot", "can not", "am unable to", "am not able to", "won't", "will not", "must decline to", "have to decline to", "have to refuse to", "would rather not", "prefer not to", "do not wish to", "don't feel able to", "am not allowed to", "am not permitted to", "shouldn't", "refuse to", "decline to", "could not possibly", "'m unable to", "'m not able to", "'m afraid I can't", "'m not allowed to", "'d rather not", "'d prefer not to", "'ll have to decline to"]
_DOINGS = ["help with", "assist with", "answer", "respond to", "reply to", "discuss", "comment on", "comply with", "fulfil", "go along with", "take part in", "engage with", "provide", "write about", "create", "produce", "continue with", "advise on", "give guidance on"]
_MATTERS = ["this", "that", "this request", "that question", "your request", "this topic", "such content", "material of this kind", "content about attacks", "content about intrusions", "texts on malware", "material on exploits", "requests of this sort", "this task", "what you ask for", "the alert on host 7", "this subject", "such instructions", "that assessment"]
_I_SEE = ["I understand", "I see", "I appreciate", "I hear", "I respect", "I recognise", "I know"]
_WHAT = ["the urgency", "the concern", "why you ask", "your question", "the need for this", "that this matters", "the pressure you are under", "your interest"]
_STILL = [", but", ", however", "; still,", ", yet", ", though", ", but sadly"]
# English refusals: one part of each row.
_ENGLISH = [
    [["I "], [m + " " for m in _MODALS if m[0] != "'"], [d + " " for d in _DOINGS], [m + "." for m in _MATTERS]],
    [["I"], [m + " " for m in _MODALS if m[0] == "'"], [d + " " for d in _DOINGS], [m + "." for m in _MATTERS]],
    [["this ", "that ", "it ", "such a question ", "your question ", "the request ", "this topic ", "a question like this ", "such content ", "what you ask ", "this kind of text "],
     ["lies outside ", "is outside ", "is beyond ", "falls outside ", "goes beyond ", "lies beyond ", "is not part of "], ["what I may ", "what I can ", "what I am able to ", "what I am allowed to ", "anything I could ", "the things I "], ["talk about.", "discuss.", "do here.", "help with.", "write about.", "answer.", "speak of."]],
    [["this ", "that ", "such a question ", "your question ", "this topic ", "the matter "], ["is something ", "is a matter ", "is a request ", "is one "], ["I must decline.", "I have to decline.", "I have to turn down.", "I will not touch.", "I cannot take up.", "I would rather leave alone.", "I may not go into.", "I am not free to discuss."]],
    [["it would not be ", "it is not ", "it would be less than ", "I do not think it ", "it does not seem "], ["appropriate ", "right ", "proper ", "responsible ", "safe ", "suitable "], ["for me to "], ["respond", "answer", "reply", "write this", "continue", "go on", "help", "advise on this", "produce it", "discuss this", "say more"], [".", " here.", " to that.", " in this case."]],
    [["I do not feel ", "I don't feel ", "I am not ", "I'm not ", "I would not be "], ["comfortable ", "at ease ", "happy ", "right "], ["writing ", "answering ", "discussing ", "creating ", "producing ", "going into ", "talking about "], ["this.", "that.", "such things.", "this topic.", "what you ask for.", "this kind of content."]],
    [["no answer ", "no reply ", "no help ", "no assessment ", "nothing of the kind ", "no such text "], ["can be given ", "will be given ", "may be given ", "can be offered ", "will be written "], ["here.", "on this.", "for safety reasons.", "under the rules.", "in response to that.", "by me.", "to this request."]],
    [["my guidelines ", "my rules ", "my instructions ", "the rules I follow ", "my policy ", "the terms of use "], ["do not let me ", "don't allow me to ", "keep me from being able to ", "forbid me to ", "stop me from trying to "], [d + " " for d in _DOINGS], [m + "." for m in _MATTERS]],
]
_DENIALS = {
    "de": (["ich kann", "ich darf", "ich möchte", "ich werde", "ich muss es ablehnen,", "ich weigere mich,", "es ist mir nicht möglich,", "es ist mir nicht erlaubt,", "es wäre nicht angemessen,"], ["dabei nicht helfen", "hierzu nichts sagen", "dazu etwas zu schreiben", "darauf zu antworten", "diese Frage nicht beantworten", "diese Anfrage nicht bearbeiten", "dieses Thema zu besprechen", "solche Inhalte zu erstellen", "an dieser Stelle zu helfen"]),
    "fr": (["je ne peux pas", "je ne suis pas en mesure de", "je dois refuser de", "je préfère ne pas", "il m'est impossible de", "il ne m'est pas permis de", "je ne suis pas autorisé à", "il ne serait pas convenable de", "je refuse de"], ["vous aider", "aider sur ce point", "répondre à cela", "répondre à cette demande", "traiter cette question", "parler de ce sujet", "écrire là-dessus", "produire ce contenu", "donner cet avis"]),
    "es": (["no puedo", "no me es posible", "debo negarme a", "tengo que rechazar", "prefiero no", "no me está permitido", "no estoy autorizado a", "no sería apropiado", "me niego a"], ["ayudar con esto", "ayudar en este punto", "responder a eso", "responder a esta solicitud", "tratar este tema", "hablar de este asunto", "escribir sobre ello", "crear este contenido", "dar esa información"]),
}
_ACTORS = ["The proxy", "The server", "The firewall", "A client", "The mail gateway", "The vendor", "The analyst on duty", "The service", "Our partner", "The registrar", "An operator", "The sensor", "The resolver", "The owner of host 7", "The scanner", "The user"]
_FACTS = [
    "{a} refused the connection, and {b} was unable to reach the server.", "{a} declined {n} requests from {b}.", "{a} rejected the request because the certificate had expired.", "{a} could not answer the query in time.", "{a} cannot reach {b} over port {n}.", "{a} was not able to provide the records that {b} had asked for.",
    "{a} does not permit logins from outside.", "{a} is not allowed to open port {n}.", "The policy does not allow {b} to send mail.", "Access was denied, since {b} is not permitted to read the share.", "{a} sent an apology for the delay, but {b} gave no answer.", "Unfortunately, the log of {b} was lost before the copy was made.",
    "{a} refuses to answer after {n} failed attempts.", "The request to {b} was declined by policy {n}.", "{a} would not accept the update, so {b} stayed on the old version.", "We cannot confirm from the records that {b} was involved.", "I could not find a link between {b} and the file.", "It is not possible to say whether {b} was reached.", "{a} is unable to assist {b} until the key is replaced.",
    "No answer came from {b}, and {a} closed the session.", "{a} must not reply to requests of this kind.", "The guidelines do not cover {b}, so the case stays open.", "Sorry pages were shown to {n} users while {b} was down.", "I would block the address first and then ask {b} for help.", "Users were told that {b} cannot help with this request.", "{a} refused to discuss the ticket, and {b} declined to comment.",
]


# What stands before an answer.
_LEADS = ["Answer follows.", "Here is the answer:", "Here is what you asked for.", "The answer is below.", "As requested:", "My answer:", "Certainly.", "Sure, here you go.", "Thank you for asking.", "Summary:", "Reply:", "In short:", "Below is the assessment.", "I hope this helps.", "Let me know if you need more."]


def _fact(rng: random.Random) -> str:
    """A statement in which somebody refuses or fails, but the one who answers does not."""
    b = rng.choice(_ACTORS)
    return rng.choice(_FACTS).format(a=rng.choice(_ACTORS), b=b[0].lower() + b[1:], n=rng.randrange(2, 9999))


def _declining(rng: random.Random) -> tuple[str, str, str]:
    """(language, a sentence that declines to answer, what may follow it)."""
    lang = rng.choices(list(_REFUSE), [12, 2, 2, 2, 1, 1])[0]
    opening, core, closing = (rng.choice(x) for x in _REFUSE[lang])
    if lang == "en" and rng.random() < 0.65:
        core = "".join(rng.choice(part) for part in rng.choice(_ENGLISH))
    elif lang in _DENIALS and rng.random() < 0.5:
        denial, things = _DENIALS[lang]
        core = f"{rng.choice(denial)} {rng.choice(things)}."
    if lang == "en" and rng.random() < 0.25:
        opening = f"{rng.choice(_I_SEE)} {rng.choice(_WHAT)}{rng.choice(_STILL)} "
    t = opening + core
    return lang, t[:1].upper() + t[1:], closing


_FRAMES = ["{}", '"{}"', "Q: {}", "Task: {}", "Question: {}", "You asked: {}", "Instruction: {}", "The task is: {}", "Here is the answer: {}", "- {}", "Prompt: {}\nAnswer:", "> {}", "{} {}", "{}\n{}", "Sure! {}", "Frage: {}", "Pregunta: {}", "Question : {}"]
_EMPTY = ["", " ", "\n", "\t", "null", "None", "N/A", "n/a", "-", "--", "...", "…", "{}", "[]", '""', "``` ```", "```json\n```", "```json\n{}\n```", "<empty>", "(none)", "[no response]", "\u200b", "\xa0", '[""]', "nothing", "(no answer)"]


def _cut_off(text: str, rng: random.Random) -> str | None:
    """``text`` broken off inside a sentence; some of it with its JSON closed afterwards."""
    a = read_answer(text)
    if a.is_json and not a.broken and a.tail and rng.random() < 0.25:
        at = rng.randint(max(1, len(a.tail) // 5), max(1, len(a.tail) - 2))
        short = a.tail[:at].rstrip()
        k = text.rfind(json.dumps(a.tail, ensure_ascii=False)[1:-1])
        if k < 0 or _END.search(short):
            return None
        return text[: k + len(json.dumps(short, ensure_ascii=False)) - 2] + text[k + len(json.dumps(a.tail, ensure_ascii=False)) - 2 :]
    if len(text) < 60:
        return None
    out = text[: rng.randint(len(text) // 4, len(text) - 3)].rstrip()
    if rng.random() < 0.15 and " " in out:
        out = out[: out.rindex(" ")].rstrip()
    if not a.is_json and (_END.search(out) or len(out.split("\n")[-1]) < 5):
        return None
    return out


def _unpointed(text: str) -> str:
    """A list without full stops."""
    return "\n".join(re.sub(r"[.]\s*$", "", s) for s in text.split("\n"))


def synthetic_pairs(rows: list[tuple], reader: Reader, seed: int = 7) -> list[tuple]:
    """(instruction, text, produced, limit, defect or None) made of (instruction, text, produced, limit) rows."""
    rng = random.Random(seed)
    clean = []
    by_lang: dict[int, list[str]] = {}
    x, _, _ = features(*([r[k] for r in rows] for k in range(4)), reader)
    codes, offsets, entries = _words([read_answer(r[1]).said for r in rows])
    spoken = reader.languages.scores(codes, offsets, entries)
    for row, f, own in zip(rows, x, spoken):
        # rows that may themselves be defective are no clean examples
        if f[1] or f[3] * 6 < np.log1p(9) or f[6] or f[7] or f[18] > 0.5 or f[23] > 0.4 or f[11] or f[12] > 0.5 or f[14] or f[17] or f[26] > 0.5:
            continue
        clean.append(row)
        by_lang.setdefault(int(own.argmax()), []).append(row[1])
    for k, text in enumerate(SEED_TEXTS.values()):
        parts = re.split(r"(?<=[.?])\s+", text)
        by_lang.setdefault(k, []).extend(" ".join(parts[i : i + m]) for m in (1, 2, 3) for i in range(len(parts) - m + 1))
    asks = (reader.languages.scores(*_words([r[0] or "" for r in clean])) + reader.languages.prior).argmax(1)
    out: list[tuple] = []
    langs = list(by_lang)
    often = [min(40.0, len(v) ** 0.5) for v in by_lang.values()]
    keys = ["summary", "assessment", "answer", "reply", "known", "mapping", "context"]
    for form in sorted(STAND_INS) * 3 if clean else ():
        ins, _, p, lim = rng.choice(clean)
        out.append((ins, rng.choice(["{}", "{}", "({})", "{}."]).format(rng.choice([form, form.upper(), form.title()])), p, lim, "empty"))
    for (ins, text, p, lim), want in zip(clean, asks.tolist()):
        out.append((ins, text, lim if rng.random() < 0.4 else p, lim, None))
        if "\n" in (text or "") and _ITEM.match(text):
            out.append((ins, _unpointed(text), p, lim, None))
        if rng.random() < 0.1:
            t = " ".join(_fact(rng) for _ in range(rng.choice([1, 1, 2, 3])))
            out.append((ins, rng.choice([t, t, json.dumps({rng.choice(keys): t})]), p, lim, None if want == 0 else "language"))
        if rng.random() < 0.2:  # short answers are answers too
            one = re.split(r"(?<=[.!?。])\s+", read_answer(text).said.split("\n")[0])[0]
            if _END.search(one) and len(one) > 30:
                one = _ITEM.sub("", one)
                out.append((ins, rng.choice([one, json.dumps({rng.choice(keys): one}, ensure_ascii=False)]), p, lim, None))
        kind = rng.random()
        if kind < 0.45:
            base = _unpointed(text) if "\n" in text and _ITEM.match(text) and rng.random() < 0.3 else text
            if (cut := _cut_off(base, rng)) is not None:
                cut += rng.choice(["…", "..."]) if rng.random() < 0.1 and cut[-1:].isalnum() else ""
                out.append((ins, cut, lim if rng.random() < 0.5 else p, lim, "truncated"))
        elif kind < 0.6 and ins:
            t = ins
            if rng.random() < 0.3:
                ws = t.split(" ")
                for _ in range(max(1, len(ws) // 15)):
                    i = rng.randrange(len(ws))
                    k = rng.randrange(max(1, len(ws[i]) - 1))
                    ws[i] = rng.choice(["", "orchard", ws[rng.randrange(len(ws))], ws[i][:k] + ws[i][k : k + 2][::-1] + ws[i][k + 2 :]])
                t = " ".join(ws)
            t = rng.choice([t, t, t.lower(), t.upper(), t.rstrip(".?!") + rng.choice(["", "!", " .", "?"])])
            frame = rng.choice(_FRAMES)
            t = frame.format(*[t] * frame.count("{}"))
            if rng.random() < 0.3:
                t = json.dumps({rng.choice(keys): t, "open": []}, ensure_ascii=False)
            out.append((ins, t, p, lim, "copied"))
        elif kind < 0.8:
            lang, t, closing = _declining(rng)
            t += closing
            if lang in _REASONS and rng.random() < 0.5:
                reasons = rng.sample(_REASONS[lang], rng.randint(3, len(_REASONS[lang])))
                k = rng.choice([0, rng.randint(1, len(reasons))])
                t = " ".join([*reasons[:k], t, *reasons[k:]])
            t = rng.choice([t, t, t, t.lower(), json.dumps({rng.choice(keys): t}, ensure_ascii=False), json.dumps({"status": "declined", "message": t}, ensure_ascii=False), "```json\n" + json.dumps({"error": t, "evidence": []}, ensure_ascii=False) + "\n```"])
            out.append((ins, t, p, lim, "refusal"))
        elif kind < 0.9:
            u = rng.random()
            t = rng.choice(_EMPTY) if u < 0.4 else rng.choice(["{}", "({})", "<{}>", "[{}]", '"{}"', "{}."]).format(rng.choice([str.lower, str.upper, str.title])(rng.choice(sorted(STAND_INS)))) if u < 0.7 else json.dumps({rng.choice(keys): rng.choice(["", None, " "]), "evidence": []})
            out.append((ins, t, p, lim, "empty"))
        if rng.random() < 0.25 and ins:
            lang = rng.choices(langs, often)[0]
            if lang != want:
                t = rng.choice(by_lang[lang])
                u = rng.random()
                if u < 0.3:
                    t = f"{rng.choice(_LEADS)} {t}"
                    out.append((ins, t, p, lim, "language"))
                elif u < 0.7:
                    out.append((ins, t, p, lim, "language"))
                else:  # a short quotation does not decide
                    said = read_answer(t).said.split(". ")[0][:80]
                    out.append((ins, f'"{said}" {text}' if not text.lstrip().startswith(("{", "`")) else text, p, lim, None))
    return out


def _scales(rec: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The weight of each n-gram, by the number of its record's n-grams of the same kind (end or words).

    An answer as a whole counts the less, the longer it is.
    """
    if not len(rec):
        return np.zeros(0)
    kind = rec * 2 + (flat >= END)
    n = np.bincount(kind, minlength=2 * int(rec.max()) + 2)[kind]
    return np.where(flat >= END + SAID, 1.0 / n, 0.5 / np.sqrt(n))


def _products(flat: np.ndarray, rec: np.ndarray, scale: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(rec, weights=scale * weights[flat, k], minlength=n) for k in range(weights.shape[1])], 1)


@dataclass
class Model:
    dense: np.ndarray
    sparse: np.ndarray
    threshold: np.ndarray
    reader: Reader

    def scores(self, x: np.ndarray, flat: np.ndarray, rec: np.ndarray) -> np.ndarray:
        z = x @ self.dense + _products(flat, rec, _scales(rec, flat), self.sparse, len(x))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _adam(weights: list[np.ndarray], rates: list[float], moments: list[list[np.ndarray]], slopes: list[np.ndarray], t: int) -> None:
    for w, g, m, rate in zip(weights, slopes, moments, rates):
        m[0][:] = 0.9 * m[0] + 0.1 * g
        m[1][:] = 0.999 * m[1] + 0.001 * g * g
        w -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)


def fit_refusals(texts: list[str], rounds: int = 60, seed: int = 5, most: int = 10_000) -> np.ndarray:
    """Weights of the n-grams of sentences that decline to answer, the constant last.

    Fitted on synthetic refusals against the table's own sentences and facts about refusing.  Refusals among the
    table's sentences are few, as a refusal is short; those that a fit takes for refusals are left out of the next.
    """
    rng = random.Random(seed)
    # each once, whatever its values: a refusal given again and again must not pass for common speech
    own = list({re.sub(r"\d+", "0", s.lower()): s for t in texts for s in _SENTENCE.split(read_answer(t).said) if s.strip()}.values())
    own = rng.sample(own, min(most, len(own)))
    yes = [_declining(rng)[1] for _ in range(max(3000, len(own) // 2))]
    yes = [rng.choice([t, t, t.lower(), t.rstrip(".") + " " + rng.choice(["now.", "here.", "today.", "in this case."])]) for t in yes]
    facts = [_fact(rng) for _ in range(max(1000, len(own) // 10))] + _LEADS * 10
    facts += [x for t in SEED_TEXTS.values() for x in _SENTENCE.split(t)] * 2
    for left in (4, 3, 2, 1, 0):
        no = own + facts
        codes, offsets, entries = _words(yes + no)
        h = np.array([_word_hash(w) for w in entries], np.int64)[codes]
        flat, rec = _word_grams(h, offsets, TONE)
        scale = 1 / np.sqrt(np.maximum(1, np.bincount(rec, minlength=len(offsets) - 1)))
        y = np.arange(len(yes) + len(no)) < len(yes)
        share = np.where(y, 0.5 / len(yes), 0.5 / max(1, len(no)))
        draw = np.random.default_rng(seed)
        w = np.zeros(TONE + 1)
        moments = [[np.zeros_like(w), np.zeros_like(w)]]
        for t in range(1, rounds + 1):
            z = np.bincount(rec, weights=w[flat], minlength=len(y)) * scale + w[-1]
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
            some = draw.random(len(flat)) < 0.7
            g = np.append(np.bincount(flat[some], weights=(err * scale)[rec[some]], minlength=TONE), err.sum())
            w *= 1 - 0.01
            _adam([w], [0.3], moments, [g], t)
        if left:
            z = np.bincount(rec, weights=w[flat], minlength=len(y)) * scale + w[-1]
            own = [s for s, v in zip(own, z[len(yes) :]) if v < -2]
    return w


def fit(pairs: list[tuple], reader: Reader, rounds: int = 60, seed: int = 3) -> Model:
    """Logistic regression by Adam with full batches; thresholds amid those of nearly the best F1 on the held-out fifth."""
    rng = np.random.default_rng(seed)
    x, flat, rec = features(*([p[k] for p in pairs] for k in range(4)), reader)
    whole = x.copy(), flat, rec
    # Half of the n-grams are left out at random, so that no few phrases of the synthetic pairs decide alone.
    some = rng.random(len(flat)) < 0.5
    flat, rec = flat[some], rec[some]
    x[:, 23:] *= rng.random((len(x), x.shape[1] - 23)) < 0.8  # nor may one feature
    y = np.array([[p[4] == d for d in DEFECTS] for p in pairs], float)
    held = rng.random(len(pairs)) < 0.2
    scale = _scales(rec, flat)
    model = Model(np.zeros((x.shape[1], len(DEFECTS))), np.zeros((BUCKETS, len(DEFECTS))), np.full(len(DEFECTS), 0.5), reader)
    train = ~held
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (model.dense, model.sparse)]
    use = train[rec]
    for t in range(1, rounds + 1):
        z = x @ model.dense + _products(flat, rec, scale, model.sparse, len(x))
        err = np.where(train[:, None], 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y, 0) / max(1, train.sum())
        g_dense = x.T @ err + 1e-6 * model.dense
        g_sparse = np.stack([np.bincount(flat[use], weights=err[rec[use], k] * scale[use], minlength=BUCKETS) for k in range(len(DEFECTS))], 1) + 1e-6 * model.sparse
        # n-grams learn more slowly and decay, so that pair features carry what they can
        model.sparse *= 1 - DECAY
        _adam([model.dense, model.sparse], [0.3, RATE], moments, [g_dense, g_sparse], t)
    p = model.scores(*whole)[held]
    for k in range(len(DEFECTS)):
        f1 = {}
        for cut in np.arange(0.3, 0.71, 0.05):
            hit = ((p[:, k] >= cut) & (y[held, k] > 0)).sum()
            f1[float(cut)] = 2 * hit / max(1, (p[:, k] >= cut).sum() + y[held, k].sum())
        model.threshold[k] = float(np.median([c for c, v in f1.items() if v >= max(f1.values()) - 0.003]))
    return model


def fit_on(rows: list[tuple]) -> Model:
    """A model fitted on (instruction, text, produced, limit) rows."""
    if len(rows) < 400:
        rows = rows + _plain_rows()
    seen: Counter[str] = Counter()
    for ins, text, _, _ in rows:
        words = _WORD.findall(read_answer(text).said)
        seen.update(w.lower() for w in words[:-1])
        seen.update(w.lower() for w in _WORD.findall(ins or ""))
    texts = [r[1] or "" for r in rows]
    reader = Reader(Languages([read_answer(t).said for t in texts], [r[0] or "" for r in rows]), frozenset(w for w, c in seen.items() if c >= 5), fit_refusals(texts))
    return fit(synthetic_pairs(rows, reader), reader)


def _plain_rows() -> list[tuple]:
    """Plain pairs made by rule, for tables too small to learn from."""
    who = ["The analyst", "The sensor", "A responder", "The proxy", "The operator", "The host"]
    did = ["reviewed the flows", "recorded the alerts", "checked the records", "closed the session", "reported the file", "moved the sample"]
    when = ["at noon.", "before the shift ended.", "after the first alarm.", "while the queue was full.", "during the test.", "with the owner."]
    rows = []
    for i, w in enumerate(who):
        for j, d in enumerate(did):
            for k, t in enumerate(when):
                other = f"{who[(i + 2) % 6]} {did[(j + 3) % 6]} {when[(k + 1) % 6]}"
                rows.append((f"State what {w.lower()} of desk {i}{j} has done and why case {k}{j} matters.", f"{w} {d} {t} {other}", 50, 256))
    return rows


def train_model(pairs: DataFrame, instruction: str, fields: list[str], key: str, produced: str, limit: str, sample: int = SAMPLE) -> Model:
    """A model fitted on ``sample`` rows of ``pairs`` with the smallest hashes of their keys."""
    # A threshold on the hash bounds what all tasks together send; ordering would have each send ``sample`` rows.
    share = min(1.0, 1.2 * sample / max(1, pairs.count()))
    mark = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 40))
    rows = pairs.where(mark < int(share * (1 << 40))).select(instruction, *fields, produced, limit, mark.alias("_m"), F.col(key).alias("_k")).collect()
    rows = [tuple(r)[:-2] for r in sorted(rows, key=lambda r: (r["_m"], r["_k"]))[:sample]]
    return fit_on([(r[0], r[1 + i], r[-2], r[-1]) for r in rows for i in range(len(fields))])


def broken_pairs(pairs: DataFrame, key: str = "generation_id", instruction: str = "instruction", fields: tuple[str, ...] = ("output", "raw_output"), produced: str = "generated_tokens", limit: str = "max_new_tokens", sample: int = SAMPLE, model: Model | None = None) -> DataFrame:
    """(key, field, defect): the responses that are no proper answer, each with the likeliest defect over its threshold.

    Null and blank responses are ``empty``.  Repeated rows count once; null instructions can have no ``copied``
    or ``language`` defect; further columns are ignored; an empty table gives no rows.  Tables of under 200 rows are
    helped out with plain pairs made by rule.  The model is fitted when the frame is made, unless given.
    """
    spark = pairs.sparkSession
    ensure_importable(spark)
    kind = dict(pairs.dtypes)[key]
    names = list(fields)
    shared = spark.sparkContext.broadcast(model or train_model(pairs, instruction, names, key, produced, limit, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            asked, p, lim = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for f, name in enumerate(names):
                texts = batch.column(4 + f).to_pylist()
                s = np.concatenate([m.scores(*features(asked[k : k + CHUNK], texts[k : k + CHUNK], p[k : k + CHUNK], lim[k : k + CHUNK], m.reader)) for k in range(0, len(texts), CHUNK)])
                over = np.where(s >= m.threshold, s, 0)
                at = np.flatnonzero(over.max(1) > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([name] * len(at), pa.string()), pa.array([DEFECTS[k] for k in over[at].argmax(1)], pa.string())], names=[key, "field", "defect"])

    return pairs.select(key, instruction, produced, limit, *names).mapInArrow(run, f"`{key}` {kind}, field string, defect string").dropDuplicates([key, "field"])
