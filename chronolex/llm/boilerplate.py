"""Problem 2: lines of a page that aren't its author's text, by a recurrent labeller over the whole page.

Each line is a leaf of the page. Its vector joins what its tag path would tell (marks, shape, place, ties to
the page's address; the tables hold no markup) with the mean of its hashed words' vectors; a bidirectional LSTM reads the sequence
and labels each line with the whole page in view. There are no labels, so it learns on a bounded sample from what stands on many
pages of a site that tell different stories, from layout and from cue phrases, and generalises from words and neighbours to
lines that have none of these. What it finds where phrases or sites were held out is in the tests and the README.
"""

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex import scratch
from chronolex.llm import sampling, textvec
from chronolex.llm.textvec import U

WORD_BUCKETS, WORD_DIM, HIDDEN = 4096, 24, 24
#: documents that training takes at most
SAMPLE = 1600
EPOCHS, BATCH = 7, 32

#: fixed values: phrases of page furniture, by language (regular expressions over lower-case lines)
CUES = {
    "en": r"cookies|accept all|manage preferences|your privacy|information on your device|skip to content|^menu$|^search |sign in|log in|newsletters?$|my account|^home ?[>|/]|you are here|^topics /|front page|^about( us)?$|^sitemap$|^imprint|^contact$|^privacy$|loading…|share this|^share ·|· email|copy link|subscribe|in your inbox|thanks for reading|\d+ comments?$|join the discussion|©|copyright|all rights reserved|terms of use|accessibility statement|registered office|may not be published|views expressed here|staff writer for|^words: |^by [^.]*\||min read|^written by|updated \d+ hours|^photo: |about the author|filed under|^tags: |related stories|you may also like|^more from|^most read|^see also|^read (also|more)|sponsored|advertisement|story continues|page not found|for subscribers|enable javascript",
    "fr": r"acceptez l'us|à votre appareil|sur votre appareil|tout accepter|vos données|confidentialité|accueil ?[>|/]|vous êtes ici|se connecter|^à propos|lettres d'information|partager|· courriel|abonne[zr]|réservé aux|merci de lire|\d+ commentaires?$|pour répondre|tous droits|mentions légales|toute reproduction|opinions exprimées|, pour [^.]{3,30}$|^lecture \d+ min|crédit photo|^classé dans|mots-clés|à lire aussi|les plus lus|^voir aussi|^lire (aussi|la suite)|après cette annonce|publicité|page introuvable|plan du site",
    "de": r"wir verwenden cookies|informationen auf ihrem gerät|alle akzeptieren|datenschutz|impressum|startseite|sie sind hier|anmelden|über uns|^kontakt|teilen|· mailen|drucken$|abonn|\d+ kommentare?$|zum antworten|alle rechte|nachdruck und|geäußerten ansichten|^[^.,:]+ für [^.,:]{3,30}$|lesezeit|^foto|abgelegt unter|schlagworte|lesen sie auch|meistgelesen|^siehe auch|^mehr (dazu|lesen)|nach der werbung|^anzeige|nicht gefunden",
    "es": r"uso de cookies|información en su dispositivo|aceptar todo|privacidad|inicio ?[>|/]|^está en|iniciar sesión|inicie sesión|quiénes somos|boletines|compartir|· correo|suscr[ií]b|gracias por leer|\d+ comentarios?$|todos los derechos|aviso legal|queda prohibida|opiniones aquí|, para [^.]{3,30}$|lectura de|^foto de|archivado en|etiquetas:|también le puede|lo más leído|^véase también|^(lea|leer) (también|más)|publicidad|continúa tras|página no encontrada",
    "pt": r"uso de cookies|informações no seu|aceitar tudo|privacidade|início ?[>|/]|você está em|^entrar$|entre para responder|quem somos|compartilh|· e-mail|assin(e|antes|atura)|obrigado por ler|\d+ comentários?$|todos os direitos|é proibida a|opiniões (aqui|expressas)|leitura de \d+|arquivado em|marcadores:|leia também|mais lidas|^veja também|^(saiba|leia) mais|continua (após|depois)|página não encontrada|mapa do site",
}
_CUE = re.compile("|".join(CUES.values()))
_COMMENTS = re.compile(r"\d+ (comments?|commentaires?|kommentare?|comentarios?|comentários?)$|join the discussion|log in to reply|pour répondre|zum antworten|inicie sesión para responder|para responder")
_TEASERS = re.compile(r"related stories|you may also like|^more from|^most read|à lire aussi|les plus lus|lesen sie auch|meistgelesen|también le puede|lo más leído|leia também|mais lidas")
_POST = re.compile(r"^[^\s:]+\d+: |^[^.,:]{5,40} — ")
_END = ".!?»…”\"')"


def _letters(line: str) -> str:
    return re.sub(r"[\W\d_]+", "", line.lower())


def _template(line: str) -> str:
    """The letters of a line without its capitalised words: what bylines and notes on authors share."""
    key = "~" + _letters(re.sub(r"\b[^\W\d_a-zà-ÿ]\w*", "", line))
    return key if len(key) > 20 else ""


def furniture(texts: list, urls: list, stories: int = 3) -> list[set]:
    """For each page the letters of its short lines that stand in at least `stories` pages of its site that tell different stories, and such templates.

    Pages tell one story if their longest lines agree, so copies of a story don't make its paragraphs furniture.
    """
    host = [re.sub(r"^www\.", "", (m[1] if (m := re.match(r"^[a-z+.\-]*:?//([^/?#]*)", (u or "").lower())) else "")) for u in urls]
    keys = [{k for x in (t or "").split("\n") if len(x) < 240 for k in (_letters(x), _template(x)) if len(k) > 2} for t in texts]
    story = [_letters(max((t or "").split("\n"), key=len)) for t in texts]
    seen: dict[tuple, set] = {}
    for h, own, s in zip(host, keys, story, strict=True):
        for k in own:
            seen.setdefault((h, k), set()).add(s)
    return [{k for k in own if h and len(seen[h, k]) >= stories} for h, own in zip(host, keys, strict=True)]


def weak_labels(text: str, title: str | None, repeated: set = frozenset(), cues: re.Pattern | None = _CUE, untold: re.Pattern | None = None) -> list[int]:
    """For each line 1 (the author's), 0 (the page's) or -1 (not told), by repetition on the site, cue phrases and layout.

    Comments and teasers have no cues of their own: they are the lines after the heads of such sections,
    as long as no paragraph follows. Blank lines aren't told. repeated: what furniture() found; cues: phrases of furniture, None
    for repetition and layout alone; lines with an `untold` phrase aren't told, whatever else speaks.
    """
    raw = text.split("\n")
    lines = [re.sub(r"\s+", " ", x).strip() for x in raw]
    low = [x.lstrip("» ").lower() for x in lines]
    cue = [0 < len(x) < 240 and x.count(". ") < 3 and (bool(cues and cues.search(x)) or _letters(x) in repeated) for x in low]
    letters = _letters
    head = letters(title or "")
    long = [not c and len(x) > 150 for c, x in zip(cue, lines, strict=True)]
    edges = [i for i, x in enumerate(long) if x]
    if edges:  # templates only count around the paragraphs
        cue = [c or ((i < edges[0] or i > edges[-1]) and len(x) < 240 and _template(x) in repeated) for i, (c, x) in enumerate(zip(cue, lines, strict=True))]
    body = [i for i, x in enumerate(lines) if not cue[i] and (long[i] or (len(x) > 40 and x[-1] in _END and not _POST.search(x)))]
    first = body[0] if body else len(lines)
    last_long = max((i for i, x in enumerate(long) if x), default=-1)
    told = set(body)
    tail = next((i for i in range(max(last_long, 0), len(lines)) if cues and (_COMMENTS.search(low[i]) or _TEASERS.search(low[i]))), len(lines))
    out = []
    for i, x in enumerate(lines):
        if not any(c.isalpha() for c in x) or (untold and untold.search(low[i])):
            out.append(-1)
        elif cue[i]:
            out.append(0)
        elif i > tail:
            out.append(0)
        elif len(head) >= 15 and i <= max(first, 8) and i < 12 and len(letters(x)) >= 15 and (head.startswith(letters(x)[:60]) or letters(x).startswith(head[:60])) and x[-1] not in _END:
            out.append(0)
        elif i < first and len(x.split()) <= 4 and x[-1] not in _END:
            out.append(0 if i < 8 else -1)
        elif i > last_long >= 0 and len(x.split()) <= 4 and x[-1] not in _END and "|" not in x and raw[i][:1] not in " \t":
            out.append(-1)
        else:
            # without phrases a short line outside the paragraphs may be either
            out.append(1 if cues or i in told or first <= i <= last_long else -1)
    return out


def _pieces(first: np.ndarray, size: np.ndarray, most: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the pieces of at most `most` lines that sequences are learnt in; all lines are in one."""
    n = np.maximum(-(-size // most), 1)
    turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(first, n) + turn * most, np.minimum(np.repeat(size, n) - turn * most, most)


class Leaves:
    """Lines of some pages as leaf sequences: `path` vectors, and the hashed words of each line."""

    def __init__(self, texts: list, urls: list):
        texts = [re.sub(r"[^\S\n\t ]", " ", t or "") if t and not t.isascii() else t or "" for t in texts]
        raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        # one code point each: what changes its length in lower case stays
        w = textvec.Words([t if len(t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in texts])
        kind = w.kind
        end = np.flatnonzero(raw == 10)
        start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
        bounds = np.append(np.searchsorted(start, w.starts[:-1]), len(start))
        self.first, self.size = bounds[:-1], np.diff(bounds)
        self.doc = np.repeat(np.arange(len(texts)), self.size)
        self.number = np.arange(len(start)) - bounds[self.doc]
        n = len(start)

        def count(mask):
            total = np.zeros(len(raw) + 1, np.int64)
            np.cumsum(mask, out=total[1:])
            return total[end] - total[start]

        letter, digit = kind == textvec.LETTER, (raw >= 48) & (raw <= 57)
        self.letters = count(letter)
        line_of = np.searchsorted(end, w.start)
        words = np.bincount(line_of, minlength=n)
        space = (raw == 32) | (raw == 9) | (raw == 10)
        solid = np.flatnonzero(~space)
        head = np.zeros(n, np.uint32)
        tail = np.zeros(n, np.uint32)
        if len(solid):
            a = np.minimum(np.searchsorted(solid, start), len(solid) - 1)
            b = np.maximum(np.searchsorted(solid, end) - 1, 0)
            ok = (solid[a] >= start) & (solid[a] < end)
            head[ok], tail[ok] = raw[solid[a[ok]]], raw[solid[b[ok]]]
        is_in = lambda x, chars: np.isin(x, np.array([ord(c) for c in chars], np.uint32))
        slug, site = _addresses(urls)
        tied = np.isin(textvec.mix(w.hash ^ (w.doc.astype(np.uint64) * U(0x9E3779B97F4A7C15))), slug)
        tied_n = np.bincount(line_of, weights=tied, minlength=n)
        named = np.zeros(n)
        if len(w.start) > 1:
            pair = textvec.span_hashes(w.cp, w.start[:-1], w.end[1:], letter)
            hit = (pair == site[w.doc[:-1]]) & (line_of[:-1] == line_of[1:])
            named = np.bincount(line_of[:-1][hit], minlength=n)
            single = textvec.span_hashes(w.cp, w.start, w.end, letter) == site[w.doc]
            named = np.minimum(named + np.bincount(line_of[single], minlength=n), 1)
        some = np.maximum(self.letters, 1)
        up = count(raw != w.cp)
        place, left = self.number, self.size[self.doc] - 1 - self.number
        cols = [
            self.letters == 0, np.log1p(self.letters) / 6, np.log1p(words) / 4, count(digit) / (some + count(digit)), up / some, (up > 0.7 * some) & (self.letters > 3),
            is_in(tail, _END), tail == 58, is_in(head, "-*•"), is_in(head, "›"), is_in(head, "»"), is_in(head, ">"), head == 169, (head >= 48) & (head <= 57), is_in(head, "$#{"),
            count(raw == 124) > 0, count(raw == 183) > 0, count(raw == 47) > 0, count(raw == 64) > 0, count(raw == 58) > 0, count(raw == 0x2014) > 0, count(raw == 62) > 0, count(is_in(raw, "_{}=<()")) > 1,
            np.minimum(count(is_in(raw, ".!?")), 6) / 6, np.exp(-place / 2), np.exp(-place / 8), np.exp(-left / 2), np.exp(-left / 8), np.log1p(self.size[self.doc]) / 5,
            tied_n / np.maximum(words, 1), np.minimum(tied_n, 8) / 8, named, is_in(raw[start], " \t"), self.letters > 120, (self.letters > 25) & (self.letters <= 120),
        ]
        self.path = np.column_stack([np.asarray(c, np.float32) for c in cols])
        self.bucket = (w.hash >> U(40)).astype(np.int64) % WORD_BUCKETS
        self.word_line, self.words = line_of, words


PATH_DIM = 35


def _addresses(urls: list) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words of each address's last path part, and a hash of the main label of its host."""
    hosts, slugs = [], []
    for u in urls:
        m = re.match(r"^[a-z+.\-]*:?//([^/?#]*)([^?#]*)", (u or "").lower())
        labels = (m[1] if m else "").removeprefix("www.").split(".")
        hosts.append(labels[0])
        slugs.append(re.sub(r"[\W_]+", " ", m[2].rstrip("/").rsplit("/", 1)[-1]) if m else "")
    w = textvec.Words(slugs)
    keep = w.end - w.start > 2
    keys = textvec.mix(w.hash[keep] ^ (w.doc[keep].astype(np.uint64) * U(0x9E3779B97F4A7C15)))
    cp, starts = textvec.code_points(hosts)
    letter = textvec.classes()[cp] == textvec.LETTER
    site = textvec.span_hashes(cp, starts[:-1], starts[1:] - 1, letter)
    site[[not h for h in hosts]] = U(1)
    return keys, site


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _lstm(z, u, mask, keep=False):
    """States of an LSTM over z (steps x pages x 4 hidden); pages outside the mask keep theirs."""
    steps, pages, four = z.shape
    n = four // 4
    h, c = np.zeros((pages, n), np.float32), np.zeros((pages, n), np.float32)
    out = np.zeros((steps, pages, n), np.float32)
    cache = []
    for t in range(steps):
        a = z[t] + h @ u
        gates = _sigmoid(a[:, : 3 * n])
        i, f, o, g = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], np.tanh(a[:, 3 * n :])
        m = mask[t][:, None]
        new = f * c + i * g
        th = np.tanh(new)
        if keep:
            cache.append((h, c, i, f, o, g, th, m))
        h = np.where(m, o * th, h)
        c = np.where(m, new, c)
        out[t] = h
    return out, cache


def _lstm_back(dout, cache, u):
    """Gradients of _lstm: of z and of u."""
    steps, pages, n = dout.shape
    dz, du = np.zeros((steps, pages, 4 * n), np.float32), np.zeros_like(u)
    dh, dc = np.zeros((pages, n), np.float32), np.zeros((pages, n), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, th, m = cache[t]
        dh = dh + dout[t]
        live, lc = dh * m, dc * m
        dnew = live * o * (1 - th**2) + lc
        da = np.concatenate((dnew * g * i * (1 - i), dnew * c * f * (1 - f), live * th * o * (1 - o), dnew * i * (1 - g**2)), axis=1)
        dz[t] = da
        du += h.T @ da
        dh = da @ u.T + dh * ~m
        dc = dnew * f + dc * ~m
    return dz, du


class Labeller:
    """The bidirectional LSTM and its parameters."""

    def __init__(self, params: dict[str, np.ndarray] | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        d, n = PATH_DIM + WORD_DIM, HIDDEN
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = params or {"words": (0.3 * rng.standard_normal((WORD_BUCKETS, WORD_DIM))).astype(np.float32), "wx": init(d, 8 * n), "b": np.zeros(8 * n, np.float32), "uf": init(n, 4 * n), "ub": init(n, 4 * n), "wo": init(2 * n + d, 1), "bo": np.zeros(1, np.float32)}

    def inputs(self, leaves: Leaves) -> np.ndarray:
        mean = np.zeros((len(leaves.path), WORD_DIM), np.float32)
        if len(leaves.bucket):
            vectors = np.cumsum(self.p["words"][leaves.bucket], axis=0, dtype=np.float64)
            vectors = np.concatenate((np.zeros((1, WORD_DIM)), vectors))
            at = np.concatenate(([0], np.cumsum(leaves.words)))
            mean = ((vectors[at[1:]] - vectors[at[:-1]]) / np.sqrt(np.maximum(leaves.words, 1))[:, None]).astype(np.float32)
        return np.concatenate((leaves.path, mean), axis=1)

    def _grid(self, leaves: Leaves, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = leaves.size[docs]
        steps = int(size.max())
        mask = np.arange(steps)[:, None] < size[None, :]
        return np.where(mask, leaves.first[docs][None, :] + np.arange(steps)[:, None], 0), mask

    def forward(self, x: np.ndarray, grid: np.ndarray, mask: np.ndarray, keep: bool = False):
        n = HIDDEN
        z = (x @ self.p["wx"] + self.p["b"])[grid]
        hf, cf = _lstm(z[:, :, : 4 * n], self.p["uf"], mask, keep)
        hb, cb = _lstm(z[::-1, :, 4 * n :], self.p["ub"], mask[::-1], keep)
        h = np.concatenate((hf, hb[::-1], x[grid]), axis=2)
        return (h @ self.p["wo"] + self.p["bo"])[:, :, 0], h, cf, cb

    def predict(self, leaves: Leaves) -> np.ndarray:
        """The log odds of each line to be the author's."""
        out = np.zeros(len(leaves.path), np.float32)
        x = self.inputs(leaves)
        order = np.argsort(leaves.size, kind="stable")
        order = order[leaves.size[order] > 0]
        for k in range(0, len(order), 128):
            grid, mask = self._grid(leaves, order[k : k + 128])
            out[grid[mask]] = self.forward(x, grid, mask)[0][mask]
        return out

    def fit(self, leaves: Leaves, labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.006, seed: int = 3) -> "Labeller":
        rng = np.random.default_rng(seed)
        leaves.first, leaves.size = _pieces(leaves.first, leaves.size)
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        at = np.concatenate(([0], np.cumsum(leaves.words)))
        step, n = 0, HIDDEN
        docs = np.flatnonzero(leaves.size > 0)
        for epoch in range(epochs):
            order = docs[np.argsort(leaves.size[docs] + rng.uniform(0, 8, len(docs)))]
            groups = [order[k : k + BATCH] for k in range(0, len(order), BATCH)]
            for g in rng.permutation(len(groups)):
                grid, mask = self._grid(leaves, groups[g])
                rows = grid[mask]
                pos = np.zeros(grid.shape, np.int64)
                pos[mask] = np.arange(len(rows))
                word_at = np.concatenate([np.arange(at[r], at[r + 1]) for r in rows]) if len(rows) else np.zeros(0, np.int64)
                word_row = np.repeat(np.arange(len(rows)), leaves.words[rows])
                scale = 1 / np.sqrt(np.maximum(leaves.words[rows], 1)).astype(np.float32)
                bucket = leaves.bucket[word_at]
                # word dropout keeps the labeller from leaning on single words
                alive = rng.random(len(bucket)) > 0.15
                bucket, word_row = bucket[alive], word_row[alive]
                mean = np.zeros((len(rows), WORD_DIM), np.float32)
                np.add.at(mean, word_row, self.p["words"][bucket])
                mean *= scale[:, None]
                x = np.concatenate((leaves.path[rows], mean), axis=1)
                logit, h, cf, cb = self.forward(x, pos, mask, keep=True)
                y = labels[grid]
                told = mask & (y >= 0)
                d = np.where(told, _sigmoid(logit) - y, 0).astype(np.float32)[:, :, None] / max(told.sum(), 1)
                dh = d @ self.p["wo"].T
                grad = {"wo": np.einsum("tbk,tbo->ko", h, d), "bo": d.sum((0, 1))}
                dzf, grad["uf"] = _lstm_back(dh[:, :, :n], cf, self.p["uf"])
                dzb, grad["ub"] = _lstm_back(dh[::-1, :, n : 2 * n], cb, self.p["ub"])
                dz = np.concatenate((dzf, dzb[::-1]), axis=2)[mask]
                grad["wx"], grad["b"] = x.T @ dz, dz.sum(0)
                dx = (dz @ self.p["wx"].T + dh[:, :, 2 * n :][mask])[:, PATH_DIM:] * scale[:, None]
                grad["words"] = np.zeros_like(self.p["words"])
                np.add.at(grad["words"], bucket, dx[word_row])
                step += 1
                lr = rate * (0.3 ** (epoch / max(epochs - 1, 1)))
                for k, gk in grad.items():
                    m, v = moments[k]
                    m += 0.1 * (gk - m)
                    v += 0.001 * (gk**2 - v)
                    self.p[k] -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> "Labeller":
        return Labeller(dict(np.load(io.BytesIO(data))))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", url_col: str = "url", title_col: str = "title", sample: int = SAMPLE) -> bytes:
    """Parameters of a labeller, fitted in one task to at most `sample` documents taken by hash."""

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [p for p in parts if len(p)]
        if not parts:
            return
        pdf = pd.concat(parts).sort_values("doc_id")
        again = furniture(pdf["text"].tolist(), pdf["url"].tolist())
        labels = np.concatenate([np.array(weak_labels(t, title, r)) for t, title, r in zip(pdf["text"], pdf["title"], again, strict=True)])
        model = Labeller().fit(Leaves(pdf["text"].tolist(), pdf["url"].tolist()), labels)
        yield pd.DataFrame({"model": [model.dump()]})

    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(url_col).alias("url"), F.col(title_col).alias("title"))
    # the number of all rows, known without reading texts, bounds that of the rows with text
    chosen = scratch.written(sampling.bounded(rows, sample, "doc_id", n=docs.count()), "sample")
    found = chosen.coalesce(1).mapInPandas(fit, "model binary").collect()
    scratch.drop(chosen)
    return bytes(found[0].model) if found else Labeller().dump()


def page_lines(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", url_col: str = "url") -> DataFrame:
    """(doc_id, line_no) of the lines with a letter that the labeller takes for the page's, not the author's.

    Null texts and ids have no rows; a null or odd url only lacks its ties. Rows of one id have rows each.
    The model is the only broadcast (some 500 KB whatever the corpus); one pass without a shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller.load(sent.value)
        for batch in batches:
            ids, texts, urls = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for lo, hi in textvec.slices(texts):
                leaves = Leaves(texts[lo:hi], urls[lo:hi])
                off = np.flatnonzero((labeller.predict(leaves) < 0) & (leaves.letters > 0))
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo + leaves.doc[off]]), pa.array(leaves.number[off].astype(np.int32))], ["doc_id", "line_no"])

    return scratch.spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(url_col).alias("url")).where("doc_id is not null and text is not null")).mapInArrow(label, "doc_id long, line_no int")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return page_lines(docs, train(docs))
