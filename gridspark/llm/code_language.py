"""Natural language in comments and literals, by a character-level hidden Markov model.

States are code and eleven languages. A state emits a character given the two before it
(counts with additive smoothing, backed off to shorter contexts); staying in a state is
cheap, switching costs a fixed penalty. The Viterbi path runs over whole files, many files at
a time, and its language spans are cut to the comments and string literals. A sentence counts
for a language if most of its characters lie in that state and it has five words (Japanese,
Chinese: eight characters).

A file of more than ``PIECE`` characters is decoded in pieces that overlap by ``OVERLAP``, side by
side like files of their own; from one piece's path to the next one's it goes over where both are
in the same state. If they nowhere are, the overlap is doubled. Memory is bounded by ``CELLS``
whatever the lengths.

The model is fitted on the driver, on a bounded sample of ``FIT_MODULES`` modules of at most
``FIT_CHARS`` characters, those with the least hashes; only they are sent there. Comments and
literals whose function words or script give their language away are the labelled rows for the
languages; what has words but no label is left out, and everything else of the sample is code.
A text of each language, written for it, comes on top. All modules are segmented.

Defined results: null and empty texts give no rows; repeated rows count once; segments
without a sentence (names, paths, queries, formats, commented-out code) give none; other
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .vba_text import Segment, segments

#: Modules of the fitting sample, those with the least hashes, and the most characters of one.
FIT_MODULES, FIT_CHARS = 1500, 50_000
LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "pl", "ru", "ja", "zh")
STATES = ("code", *LANGUAGES)
SWITCH = 9.0
#: Steps of a unit of log probability.
STEPS = 16
#: Files or pieces decoded side by side, characters of them (lanes times the longest), and of one piece.
LANES, CELLS, PIECE, OVERLAP = 512, 4_000_000, 16_384, 512
#: Steps whose emissions are looked up at once.
AHEAD = 64
#: Frequent function words of each language that the others share little.
FUNCTION_WORDS = {
    "en": "the of and to is are was were this that which because before after with from for not be been has have would could should please when here our we us it otherwise if must only then there into than does do will all",
    "de": "der die das und ist sind nicht wird werden wurde wurden ein eine einen dem den des mit von für auf bitte hier weil wenn falls sonst nur diese dieser dieses wir ob zu noch aus bei nach als auch danach zuerst muss müssen",
    "fr": "le les des et est sont nous vous dans pour avec sur pas ne une cette ces puis si car donc aux du ont été être où on que qui ici avant après sans mais cela doit dont leur",
    "es": "el los las y es son se una esta este para con por no al del que porque cuando antes después está están hay pero aquí como sus más luego primero si así también nada",
    "pt": "o os as e é são não uma esta este para com por ao aos do da dos das que porque quando antes depois está estão mas aqui como mais então se também em na no nas nos pois",
    "it": "il lo gli le e è sono non una questa questo per con di del della dei delle che perché quando prima dopo poi se da si nel nella ma qui come più quindi anche alla ai agli al ancora",
    "nl": "de het een en is zijn niet wordt worden werd deze dit met van voor op naar omdat want als wanneer eerst daarna we wij nog hier niets maar ook bij uit dus of wel om te aan geen nadat voordat",
    "pl": "i w na z że się nie jest są do to przed po tu ta ten czy ponieważ jeżeli gdy więc dla od oraz ale tylko tego tej proszę najpierw a później zanim przez jak już ich lub być będą",
    "ru": "и в на не что это этот эта если так как для по из с от перед после затем мы он она они но все только или также потому чтобы при до уже нужно здесь",
}
#: Prose of each language, written for this model: what it knows beyond the sample.
BASE_TEXT = {
    "en": "In the morning people walk to the market and buy vegetables, cheese and flowers. The old man who lives next door has never told us where he was born, although everyone knows that his brother works at the harbour. We should have asked them earlier, because nothing can be changed once the letters are sent. Every child learns how to swim during the summer, and most of them enjoy it very much. She thought about what might happen tomorrow, then closed the window and went to sleep. Some things take more time than others; however, it makes little difference in the end.",
    "de": "Am Morgen gehen die Leute auf den Markt und kaufen Gemüse, Käse und Blumen. Der alte Mann, der nebenan wohnt, hat uns nie erzählt, wo er geboren wurde, obwohl jeder weiß, dass sein Bruder am Hafen arbeitet. Wir hätten sie früher fragen sollen, denn nichts lässt sich ändern, sobald die Briefe abgeschickt sind. Jedes Kind lernt im Sommer schwimmen, und den meisten macht es große Freude. Sie dachte darüber nach, was morgen geschehen könnte, schloss dann das Fenster und ging schlafen. Manche Dinge brauchen mehr Zeit als andere, doch am Ende macht es kaum einen Unterschied.",
    "fr": "Le matin, les gens vont au marché et achètent des légumes, du fromage et des fleurs. Le vieil homme qui habite à côté ne nous a jamais dit où il était né, bien que tout le monde sache que son frère travaille au port. Nous aurions dû leur demander plus tôt, car rien ne peut être changé une fois que les lettres sont envoyées. Chaque enfant apprend à nager pendant l'été, et la plupart y prennent beaucoup de plaisir. Elle pensait à ce qui pourrait arriver demain, puis ferma la fenêtre et alla se coucher. Certaines choses demandent davantage de temps que d'autres, mais finalement cela change peu.",
    "es": "Por la mañana la gente va al mercado y compra verduras, queso y flores. El hombre viejo que vive al lado nunca nos ha dicho dónde nació, aunque todos saben que su hermano trabaja en el puerto. Deberíamos haberles preguntado antes, porque nada se puede cambiar una vez que las cartas han sido enviadas. Cada niño aprende a nadar durante el verano, y a la mayoría le gusta mucho. Ella pensó en lo que podría ocurrir mañana, luego cerró la ventana y se fue a dormir. Algunas cosas necesitan más tiempo que otras, pero al final hay poca diferencia.",
    "pt": "De manhã as pessoas vão ao mercado e compram legumes, queijo e flores. O velho que mora ao lado nunca nos disse onde nasceu, embora todos saibam que o irmão dele trabalha no porto. Devíamos ter perguntado mais cedo, porque nada pode ser mudado depois que as cartas são enviadas. Cada criança aprende a nadar durante o verão, e a maioria gosta muito. Ela pensou no que poderia acontecer amanhã, então fechou a janela e foi dormir. Algumas coisas precisam de mais tempo do que outras, mas no fim a diferença não é muita.",
    "it": "La mattina la gente va al mercato e compra verdura, formaggio e fiori. Il vecchio che abita accanto non ci ha mai detto dove sia nato, anche se tutti sanno che suo fratello lavora al porto. Avremmo dovuto chiederglielo prima, perché niente si può cambiare una volta che le lettere sono state spedite. Ogni bambino impara a nuotare durante l'estate, e alla maggior parte piace molto. Lei pensava a quello che sarebbe potuto succedere domani, poi chiuse la finestra e andò a dormire. Alcune cose richiedono più tempo di altre, ma alla fine cambia poco.",
    "nl": "In de ochtend gaan de mensen naar de markt en kopen ze groente, kaas en bloemen. De oude man die hiernaast woont heeft ons nooit verteld waar hij geboren is, hoewel iedereen weet dat zijn broer in de haven werkt. We hadden het hun eerder moeten vragen, want niets kan worden veranderd zodra de brieven verstuurd zijn. Elk kind leert tijdens de zomer zwemmen, en de meeste vinden het erg leuk. Zij dacht na over wat er morgen zou kunnen gebeuren, sloot toen het raam en ging slapen. Sommige dingen kosten meer tijd dan andere, maar uiteindelijk maakt het weinig uit.",
    "pl": "Rano ludzie idą na targ i kupują warzywa, ser oraz kwiaty. Stary człowiek, który mieszka obok, nigdy nam nie powiedział, gdzie się urodził, chociaż wszyscy wiedzą, że jego brat pracuje w porcie. Powinniśmy byli zapytać ich wcześniej, bo niczego nie można zmienić, kiedy listy zostaną wysłane. Każde dziecko uczy się latem pływać i większość bardzo to lubi. Myślała o tym, co mogłoby się zdarzyć jutro, potem zamknęła okno i poszła spać. Niektóre rzeczy wymagają więcej czasu niż inne, ale w końcu różnica jest niewielka.",
    "ru": "Утром люди идут на рынок и покупают овощи, сыр и цветы. Старик, который живёт рядом, никогда не говорил нам, где он родился, хотя все знают, что его брат работает в порту. Нам следовало спросить их раньше, ведь ничего нельзя изменить, когда письма отправлены. Каждый ребёнок летом учится плавать, и большинству это очень нравится. Она думала о том, что может случиться завтра, затем закрыла окно и легла спать.",
    "ja": "朝になると人々は市場へ行き、野菜やチーズや花を買います。隣に住んでいる老人は、どこで生まれたのか一度も話してくれませんでした。もっと早く聞いておくべきでしたが、手紙を出してしまえば何も変えることはできません。子どもはみんな夏の間に泳ぎを覚えます。彼女は明日何が起こるかを考え、それから窓を閉めて眠りました。",
    "zh": "早上人们去市场买蔬菜、奶酪和鲜花。住在隔壁的老人从来没有告诉我们他在哪里出生，虽然大家都知道他的哥哥在港口工作。我们本来应该早一点问他们，因为信寄出以后什么都不能改变。每个孩子都在夏天学习游泳，大多数人非常喜欢。她想着明天可能发生的事情，然后关上窗户去睡觉了。",
}
#: How counts enter the model: sentences that a corpus repeats thousands of times count less than in proportion, base text more than once.
DAMPED, BASE_WEIGHT, SMOOTHING = 0.3, 3, 10
_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_WORD = re.compile(r"(?<!\w)[^\W\d_]+(?:['’-][^\W\d_]+)*(?!\w)")
_SENTENCE_END = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
#: Signs that a segment is code, a query, a path or a format.
_CODE_SIGN = re.compile(r"[=<>{}\[\]_|\\^~#@]|\w\(|\(\)|\w\.\w+\(|://|\w/\w+/|;\s*$|\b(?:SELECT|INSERT|UPDATE|DELETE)\b.*\b(?:FROM|INTO|SET)\b|&\s|\b(?=\w*\d)\w{16,}\b")
_KANA = re.compile(r"[぀-ヿ]")
_HAN = re.compile(r"[㐀-鿿]")

#: Letters with a symbol of their own; all others share one per script or kind.
_LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêëàâçîïôûùœñáíóúãõìòąćęłńśźż"
_SIGNS = " .,'-_()=\":;!?/\\&<>"
SYMBOLS = len(_LETTERS) + len(_SIGNS) + 9
_OTHER, _DIGIT, _UPPER, _CYRILLIC, _HIRA, _KATA, _HANS, _WIDE, _LATIN = (len(_LETTERS) + len(_SIGNS) + k for k in range(9))


def _symbol_table() -> np.ndarray:
    table = np.full(0x10000, _OTHER, np.uint8)
    for c in range(0x80, 0x250):
        if chr(c).isalpha():
            table[c] = _LATIN
    for c in _LETTERS:
        table[ord(c)] = _LETTERS.index(c)
        if len(c.upper()) == 1:
            table[ord(c.upper())] = _LETTERS.index(c)
    for c in _SIGNS:
        table[ord(c)] = len(_LETTERS) + _SIGNS.index(c)
    table[9] = len(_LETTERS) + _SIGNS.index(" ")
    table[0x2019] = len(_LETTERS) + _SIGNS.index("'")
    table[48:58] = _DIGIT
    table[0x400:0x530] = _CYRILLIC
    table[0x3040:0x30A0] = _HIRA
    table[0x30A0:0x3100] = _KATA
    table[0x3400:0xA000] = _HANS
    table[0x3000:0x3040] = _WIDE
    table[0xFF00:0xFFF0] = _WIDE
    return table


_TABLE = _symbol_table()


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _TABLE[np.minimum(codes, 0xFFFF)]
    # a capital after a small letter is a sign of an identifier
    inner = (codes[1:] >= 65) & (codes[1:] <= 90) & (codes[:-1] >= 97) & (codes[:-1] <= 122)
    out[1:][inner] = _UPPER
    return out


def label(text: str) -> str | None:
    """The language that function words or the script give away, else None."""
    if _CODE_SIGN.search(text):
        return None
    kana, han = len(_KANA.findall(text)), len(_HAN.findall(text))
    if kana + han >= 8:
        return "ja" if kana * 5 >= han else "zh" if not kana else None
    ws = [w.lower() for w in _WORD.findall(text)]
    if len(ws) < 5:
        return None
    hits = sorted(((sum(w in s for w in ws), lang) for lang, s in _SETS.items()), reverse=True)
    return hits[0][1] if hits[0][0] >= 2 and hits[0][0] >= hits[1][0] + 2 else None


class Model:
    """-log P(symbol | two before it, state) and the switch penalty, in steps of 1 / ``STEPS``.

    One byte each: the table is looked up once a character, so it should stay in the cache.
    """

    def __init__(self, table: np.ndarray, switch: float = SWITCH):
        self.table, self.switch = table, np.int32(round(switch * STEPS))

    @classmethod
    def fit(cls, texts: list[str]) -> Model:
        counts = np.zeros((len(STATES), SYMBOLS**3), np.float32)
        for text in texts:
            at = 0
            for s in segments(text):
                own = text[s.start : s.end]
                lang = label(own)
                if lang or not _CODE_SIGN.search(own) and len(_WORD.findall(own)) >= 4:  # without a label it is neither
                    _count(counts, 0, text[at : s.start])
                    at = s.end
                    if lang:
                        _count(counts, STATES.index(lang), f" {own} ")
            _count(counts, 0, text[at:])
        counts **= DAMPED
        base = np.zeros_like(counts)
        for lang in LANGUAGES:
            _count(base, STATES.index(lang), f" {BASE_TEXT[lang]} ")
            _count(base, STATES.index(lang), f" {FUNCTION_WORDS.get(lang, '')} ")
        counts += BASE_WEIGHT * base
        return cls(_smoothed(counts))

    def emissions(self, text: str, a: int = 0, b: int | None = None) -> np.ndarray:
        """Rows of the table for the characters a to b of a text."""
        b = len(text) if b is None else b
        lead = min(a, 3)  # what stands before counts, also for capitals
        s = symbols(text[a - lead : b]).astype(np.int32)
        s = np.concatenate((np.full(2, len(_LETTERS), np.int32), s))
        return ((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:])[lead:]

    def decode(self, texts: list[str], overlap: int = OVERLAP) -> list[np.ndarray]:
        """The Viterbi path of each text, as states of its characters. Lanes are filled by length."""
        pieces = []
        for k, t in enumerate(texts):
            at = 0
            while len(t) - at > PIECE + overlap:
                pieces.append((k, at, at + PIECE + overlap))
                at += PIECE
            pieces.append((k, at, len(t)))
        paths: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda p: (pieces[p][1] - pieces[p][2], p))
        at = 0
        while at < len(order):
            longest = pieces[order[at]][2] - pieces[order[at]][1]
            lanes = order[at : at + max(1, min(LANES, CELLS // max(1, longest)))]
            at += len(lanes)
            for p, path in zip(lanes, self._lanes([self.emissions(texts[k], a, b) for k, a, b in (pieces[p] for p in lanes)])):
                paths[p] = path
        out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(texts)
        for p, (k, a, b) in enumerate(pieces):
            if not a:
                out[k] = paths[p]
                continue
            both = np.flatnonzero(out[k][a:] == paths[p][: len(out[k]) - a])
            if not len(both):  # the pieces disagree everywhere: look further
                out[k] = self.decode([texts[k]], 2 * overlap)[0]
            elif len(out[k]) < b:
                over = int(both[np.abs(both - overlap // 2).argmin()])
                out[k] = np.concatenate((out[k][: a + over], paths[p][over:]))
        return out

    def _lanes(self, codes: list[np.ndarray]) -> list[np.ndarray]:
        """Paths of lanes in order of falling length.

        A cost carries its state in the last four bits and counts from the least one, so that 16 bits hold it.
        """
        lengths = np.array([len(c) for c in codes])
        most, n, kinds = int(lengths.max(initial=0)), len(codes), len(STATES)
        if not most:
            return [np.zeros(0, np.uint8) for _ in codes]
        seen = np.zeros((most, n), np.int32)
        for k, c in enumerate(codes):
            seen[: len(c), k] = c
        stayed = np.empty((most, kinds, n), np.bool_)
        from_ = np.empty((most, n), np.int16)
        own = np.arange(kinds, dtype=np.int16)[:, None]
        jump = np.int16(int(self.switch) << 4)
        cost, jumped = np.repeat(own + jump * (own > 0), n, axis=1), own + jump
        final = np.zeros(n, np.uint8)
        active = n
        for t in range(most):
            if t % AHEAD == 0:
                emitted = np.ascontiguousarray(np.take(self.table, seen[t : t + AHEAD, :active], axis=0).transpose(0, 2, 1)).astype(np.int16) << 4
            if lengths[active - 1] <= t:
                left = int(np.searchsorted(-lengths, -t, "left"))
                final[left:active] = cost[:, left:active].min(axis=0) & 15
                active = left
                cost = np.ascontiguousarray(cost[:, :active])
                emitted = np.ascontiguousarray(emitted[:, :, :active])
            least = cost.min(axis=0)
            from_[t, :active] = least
            cost -= least & ~15
            np.less_equal(cost, jump | 15, out=stayed[t, :, :active])
            np.minimum(cost, jumped, out=cost)
            cost += emitted[t % AHEAD]
        final[:active] = cost.min(axis=0) & 15
        path = np.zeros((most, n), np.uint8)
        state, lanes = final.copy(), np.arange(n)
        active = 0
        for t in range(most - 1, -1, -1):
            while active < n and lengths[active] > t:
                active += 1
            now = state[:active]
            path[t, :active] = now
            state[:active] = np.where(stayed[t, now, lanes[:active]], now, from_[t, :active] & 15)
        return [path[: lengths[k], k] for k in range(n)]


def _count(counts: np.ndarray, state: int, text: str) -> None:
    if not text:
        return
    s = symbols(text).astype(np.int64)
    s = np.concatenate(([len(_LETTERS)] * 2, s))
    np.add.at(counts[state], (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], 1)


def _smoothed(counts: np.ndarray) -> np.ndarray:
    c3 = counts.reshape(len(STATES), SYMBOLS, SYMBOLS, SYMBOLS)
    c2, c1 = c3.sum(axis=1), c3.sum(axis=(1, 2))
    p1 = (c1 + 0.5) / (c1.sum(axis=1, keepdims=True) + 0.5 * SYMBOLS)
    p2 = (c2 + SMOOTHING * p1[:, None, :]) / (c2.sum(axis=2, keepdims=True) + SMOOTHING)
    p3 = (c3 + SMOOTHING * p2[:, None, :, :]) / (c3.sum(axis=3, keepdims=True) + SMOOTHING)
    return np.ascontiguousarray(np.clip(np.rint(-np.log(p3) * STEPS), 0, 255).reshape(len(STATES), -1).T.astype(np.uint8))


def language_spans(text: str, path: np.ndarray, segs: list[Segment] | None = None) -> list[tuple[str, int, int, int, bool]]:
    """``lang, start, end, language characters, is a sentence`` of the sentences of comments and literals."""
    out = []
    for s in segs if segs is not None else segments(text):
        own = text[s.start : s.end]
        if len(own) < 8 or not path[s.start : s.end].any():
            continue
        at = 0
        for cut in [m.end() for m in _SENTENCE_END.finditer(own)] + [len(own)]:
            part = own[at:cut]
            a = s.start + at
            at = cut
            states = np.bincount(path[a : a + len(part)], minlength=len(STATES))
            top = int(states[1:].argmax()) + 1
            if states[top] * 2 < len(part.strip()) or not states[top]:
                continue
            lang = STATES[top]
            if lang in ("ja", "zh"):
                n = len(_KANA.findall(part)) + len(_HAN.findall(part))
                sentence = n >= 8
            else:
                ws = _WORD.findall(part)
                sentence = len(ws) >= 5 and not _CODE_SIGN.search(part) and states[top] * 10 >= 7 * len(part.strip())
            out.append((lang, a, a + len(part), int(states[top]), sentence))
    return out


def fit_model(modules: DataFrame, fit_modules: int = FIT_MODULES) -> Model:
    """Fit on the ``fit_modules`` modules with the least hashes.

    The hashes are spread evenly, so their number gives a bound that a few more modules than wanted lie under.
    """
    texts = modules.select(F.col("vba_source_text").alias("text"), F.xxhash64("module_id", "vba_source_text").alias("h")).filter(
        f"length(text) > 200 and length(text) <= {FIT_CHARS}"
    )
    n = texts.count()
    wanted = fit_modules + 5 * int(fit_modules**0.5) + 10
    least = texts.filter(F.col("h") < -(2**63) + int(2**64 * wanted / n)) if n > wanted else texts
    return Model.fit([r.text for r in sorted(least.collect(), key=lambda r: (r.h, r.text))[:fit_modules]])


LANGUAGE_ROWS = "module_id bigint, lang string, n_sentences int, n_chars int, share double"


def natural_language(modules: DataFrame, fit_modules: int = FIT_MODULES) -> DataFrame:
    """``module_id, lang, n_sentences, n_chars, share`` (of the module's characters) of every language found."""
    model = modules.sparkSession.sparkContext.broadcast(fit_model(modules, fit_modules))
    schema = pa.schema([("module_id", pa.int64()), ("lang", pa.string()), ("n_sentences", pa.int32()), ("n_chars", pa.int32()), ("share", pa.float64())])

    def run(batches):
        for batch in batches:
            todo = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            at = 0
            while at < len(todo):
                # as many files as fill the lanes a few times
                end, size = at, 0
                while end < len(todo) and end - at < 4 * LANES and (end == at or size + len(todo[end][1]) <= 2 * CELLS):
                    size += len(todo[end][1])
                    end += 1
                part, at, rows = todo[at:end], end, []
                for (i, text), path in zip(part, model.value.decode([t for _, t in part])):
                    found: dict[str, list[int]] = {}
                    for lang, _, _, n, sentence in language_spans(text, path):
                        got = found.setdefault(lang, [0, 0])
                        got[0] += sentence
                        got[1] += n
                    rows += [(i, lang, s, n, n / len(text)) for lang, (s, n) in found.items() if s]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    texts = modules.select(F.col("module_id").cast("bigint").alias("module_id"), F.col("vba_source_text").alias("text")).filter("text <> ''")
    # repeated rows are settled in the result: the texts themselves do not move
    return spread(texts).mapInArrow(run, LANGUAGE_ROWS).distinct()
