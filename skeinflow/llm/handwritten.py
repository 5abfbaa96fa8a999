"""Files that nobody of the repository wrote by hand, by a linear support-vector classifier.

The classifier sees a file through four sets of hashed features: character n-grams of its whole text, character n-grams of
its comments (all of them, the repository's own name masked), path components with the language, and its
shape (size, line lengths, shares of blanks, digits and code words). No list and no rule has a say when a file is scored.

Giveaways, the notices, names and shapes by which people recognise such files, label the rows of the training sample and do
nothing else. Each labelled row is shown as it is, and once more with its giveaway notices masked, so the body, the path and
the shape have to carry what they can. Whole repositories are held out: the threshold is chosen on repositories that training
never saw.

The sample for training is bounded by ``max_rows``, taken by a hash of the file, chosen by ids before any content is read;
scoring covers every file with weights of a fixed size. Training runs in one task on that bounded sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .validity import language_of

#: Bits of the hashed feature space.
BITS = 18
#: The most files that a classifier is trained on.
MAX_ROWS = 8000
#: The value of an n-gram of a comment, and of a component of the path.
NOTICE, COMPONENT = 0.2, 0.9
# Programming languages in which a file of mere data is no source.
PROGRAMMING = frozenset("python javascript typescript go java rust kotlin scala ruby php csharp swift c cpp shell".split())
# Names of lock files.
LOCK_FILES = frozenset("package-lock.json yarn.lock pnpm-lock.yaml poetry.lock pipfile.lock cargo.lock go.sum composer.lock gemfile.lock uv.lock npm-shrinkwrap.json".split())
# Directories that hold other people's code.
VENDOR_DIRS = frozenset("vendor _vendor third_party third-party thirdparty extern external node_modules bower_components".split())
# How a notice says that a program made the file: made by a machine or automatically, made by or from something, the product
# of something, not to be edited, or edits will be lost; and the same in German, French and Spanish.
_MADE = r"(?:generated|created|produced|written|made|built|compiled)"
MACHINE = re.compile(
    rf"""@generated\b|<auto-?generated|\bcode\ generated\ by\b
    |\b(?:auto|machine)-?\ ?{_MADE}\b|\bautomatically\ {_MADE}\b|\b{_MADE}\ automatically\b
    |^\W*{_MADE}\ (?:by|from|with|on|using)\b|\bis\ the\ (?:product|output)\ of\b
    |\b(?:edit|change|modification)s?\b.{{0,40}}\b(?:lost|overwritten|discarded|erased)
    |\b(?:do\ not|don't|never)\ (?:edit|modify|change|touch)(?:\ (?:this|the)\ (?:file|code|module))?\W*$
    |\b(?:erzeugt|generiert|erstellt)\b.*\bnicht\b.*\b(?:bearbeiten|ändern)\b|\bgénéré\b.*\bne\ pas\ (?:modifier|éditer)\b|\bgenerado\b.*\bno\ (?:editar|modificar)\b""",
    re.X | re.I,
)
STATED = re.compile(r"^\W*code generated by\b.*\bdo not edit\b|^\W*@generated\b|<auto-?generated\b|^\W*this (?:whole )?file (?:is|was|has been) (?:auto-?|automatically |machine-?)?generated\b", re.I)
# What is planned or wished for is not so yet.
PLANNED = re.compile(r"\b(?:TODO|FIXME|XXX|should|would|could|might)\b", re.I)
HOLDER = re.compile(r"copyright\s+(?:\(c\)\s*|©\s*)?(?:\d{4}(?:\s*-\s*\d{4})?,?\s+)?(?:by\s+)?(?:the\s+)?(?P<who>[\w.\-]+)\s+(?P<as>authors|contributors|developers|project|maintainers|team)\b", re.I)
BANNER = re.compile(r"/\*!\s*(?P<who>[\w.\-]+)\s+v?\d[\w.]*\s*\|")
UPSTREAM = re.compile(r"^\W*upstream:\s*\S+://", re.I | re.M)
_COMMENT = re.compile(r"^\s*(?:#(?!!)|//|/\*|\*|--|;|<!--|\"\"\"|''')")
_LITERAL = re.compile(r'"""(?:[^\\]|\\.)*?"""|\'\'\'(?:[^\\]|\\.)*?\'\'\'|`[^`]*`|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|-?\b(?:0x[0-9a-f]+|\d[\d_.]*(?:e[+-]?\d+)?)\b', re.S | re.I)
_CODE_WORD = re.compile(r"\b(?:def|class|function|func|return|if|for|while|import|from|require|public|static|async|await|switch|try|interface|echo|done|fi|lambda|yield|with|raise|throw|package)\b|=>")
# Literals that end on their line, comments, and in group 1 the beginning of a literal that goes on.
_QUOTED = re.compile(r'"""(?:[^\\]|\\.)*?"""|\'\'\'(?:[^\\]|\\.)*?\'\'\'|`(?:[^`\\]|\\.)*`|("""|\'\'\'|`)|"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|(?://|#).*')
_HERE = re.compile(r"<<[-~]?(['\"]?)([A-Z_]\w*)\1")
_LINE_COMMENT = re.compile(r"^\s*(?:#|//).*$", re.M)


def notices(text: str, head: int = 25, tail: int = 4) -> str:
    """The comments and doc strings among the first and the last lines, and what comments elsewhere say of the whole file.

    The comments a file begins and ends with are read to their end, however many lines that takes. Further below, where
    most comments speak of the code beside them, only lines that ``STATED``, ``HOLDER`` or ``UPSTREAM`` know are notices.
    """
    lines = text.split("\n")
    out, quoted, leading, stop = [], "", True, len(lines)
    for n, line in enumerate(lines):
        if n >= head and not leading:
            stop = n
            break
        bare = line.strip()
        if quoted:
            out.append(bare)
            if quoted in bare:
                quoted = ""
        elif bare[:3] in ('"""', "'''"):
            out.append(bare)
            if bare[:3] not in bare[3:]:
                quoted = bare[:3]
        elif _COMMENT.match(line):
            out.append(bare)
            if bare[:2] == "/*" and "*/" not in bare:
                quoted = "*/"
        elif bare and not re.match(r"(?:import|from|package|use|const|var|let|#!|\")", bare):
            if len(out) and len(lines) > head and line[:1] not in (" ", "\t", "}"):
                stop = n
                break
            leading = False
    end = len(lines)
    while end > stop and (not lines[end - 1].strip() or _COMMENT.match(lines[end - 1])):
        end -= 1
    ends = lines[min(end, max(0, len(lines) - tail)) :] if len(lines) > head else []
    return "\n".join(out + _stated(lines[stop:end]) + [x.strip() for x in ends if x.strip() and _COMMENT.match(x)])


def _stated(lines: list[str]) -> list[str]:
    """The comment lines, outside of literals of several lines, that say where the whole file comes from."""

    def told(line: str) -> bool:
        return bool(STATED.search(line) or HOLDER.search(line) or UPSTREAM.search(line))

    if not any(map(told, lines)):
        return []
    out, inside, word = [], "", ""
    for line in lines:
        if word:
            word = "" if line.strip() == word else word
        elif inside:
            inside = "" if line.count(inside) % 2 else inside
        elif _COMMENT.match(line) and line.strip()[:3] not in ('"""', "'''"):
            if told(line):
                out.append(line.strip())
        else:
            inside = next((m.group(1) for m in _QUOTED.finditer(line) if m.group(1)), "")
            if m := _HERE.search(line):
                word = m.group(2)
    return out


def comments(text: str) -> str:
    """All comments and doc strings of a text, wherever they stand, but for what other texts in it hold."""
    out, inside, word, quoted = [], "", "", ""
    for line in text.split("\n"):
        bare = line.strip()
        if word:
            word = "" if bare == word else word
        elif quoted:
            out.append(bare)
            quoted = "" if quoted in bare else quoted
        elif inside:
            inside = "" if line.count(inside) % 2 else inside
        elif bare[:3] in ('"""', "'''"):
            out.append(bare)
            quoted = bare[:3] if bare[:3] not in bare[3:] else ""
        elif _COMMENT.match(line):
            out.append(bare)
            quoted = "*/" if bare[:2] == "/*" and "*/" not in bare else ""
        else:
            if "`" in line or '"""' in line or "'''" in line:
                inside = next((m.group(1) for m in _QUOTED.finditer(line) if m.group(1)), "")
            if "<<" in line and (m := _HERE.search(line)):
                word = m.group(2)
    return "\n".join(out)


def mere_data(lang: str, text: str) -> bool:
    """Whether a text of a programming language holds literals and next to nothing else."""
    if lang not in PROGRAMMING or len(text) < 600:
        return False
    rest = _LITERAL.sub("", _LINE_COMMENT.sub("", text))
    if len(_CODE_WORD.findall(rest)) > (1 if lang in ("go", "java") else 0):
        return False
    words = re.findall(r"[A-Za-z_]\w*", rest)
    return sum(map(len, words)) < 0.12 * len(text) and len(re.sub(r"\s", "", rest)) < 0.6 * len(re.sub(r"\s", "", text))


def squeezed(lang: str, text: str) -> bool:
    """Whether a script has been minified: long lines with hardly a blank."""
    if lang not in ("javascript", "typescript", "css") or len(text) < 400:
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    return sum(map(len, lines)) > 200 * len(lines) and sum(map(text.count, " \n\t")) < 0.12 * len(text) and len(_CODE_WORD.findall(text)) > 3


def giveaways(repo: str, path: str, lang: str, text: str) -> set[str]:
    """What people recognise the file by: its notice, its holder, its name, or what it holds. Labels of training rows."""
    out = set()
    parts = path.lower().split("/")
    notes = notices(text)
    for line in notes.split("\n"):
        if MACHINE.search(line) and not PLANNED.search(line):
            out.add("machine")
    for m in [*HOLDER.finditer(notes), *BANNER.finditer(text)]:
        if m.group("who").lower() not in (repo or "").lower():
            out.add("holder")
    if UPSTREAM.search(notes):
        out.add("holder")
    if parts[-1] in LOCK_FILES:
        out.add("lock")
    if any(d in VENDOR_DIRS and i + 2 < len(parts) for i, d in enumerate(parts)):
        out.add("vendored")
    if squeezed(lang, text):
        out.add("squeezed")
    if mere_data(lang, text):
        out.add("data")
    return out


def masked(text: str) -> str:
    """The text without the notices that give it away."""
    gone = {x for x in notices(text).split("\n") if x and (MACHINE.search(x) or HOLDER.search(x) or UPSTREAM.search(x))}
    return BANNER.sub("", "\n".join(x for x in text.split("\n") if x.strip() not in gone)) if gone or BANNER.search(text) else text


def _slot(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature) >> (64 - BITS)


def _grams(data: bytes, n: int, salt: int) -> np.ndarray:
    """Slots of the n-grams of bytes, each once."""
    raw = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    if len(raw) < n:
        return np.empty(0, dtype=np.int64)
    total = np.full(len(raw) - n + 1, salt, dtype=np.uint64)
    for k in range(n):
        total = total * np.uint64(0x100000001B3) + raw[k : k + len(total)]
    total ^= total >> np.uint64(31)
    total *= np.uint64(0x9E3779B97F4A7C15)
    return np.unique((total >> np.uint64(64 - BITS)).astype(np.int64))


def _word_grams(text: str, n: int = 5) -> np.ndarray:
    """Slots of the n-grams within words, blanks around them included, each once; none reaches from word to word."""
    words = {f" {w} " for w in text.split()}
    return np.unique([_slot(f"gram:{w[k : k + n]}") for w in words for k in range(max(1, len(w) - n + 1))])


def _bucket(x: float) -> int:
    return int(np.log2(1 + max(0.0, x)) * 2)


def _without_own(text: str, repo: str) -> str:
    """Lower-case text whose numbers are zeros and in which the repository's own name is masked."""
    text = re.sub(r"\d+", "0", text).lower()
    name = re.sub(r"\d+", "0", repo).lower()
    return text.replace(name, "(own)") if name else text


def features(repo: str, path: str, lang: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values): the n-grams of the text have length one together, as have those of its shape; an n-gram of a comment
    and a component of the path weigh the same however many there are, so a short notice is not lost in long comments."""
    slots, values = [], []

    def add(some, weight: float | None = None) -> None:
        if len(some):
            slots.append(np.asarray(some, dtype=np.int64))
            values.append(np.full(len(some), weight or 1 / np.sqrt(len(some)), dtype=np.float32))

    data = text.encode("utf-8", "replace")
    add(np.concatenate([_grams(data, 4, 1), _grams(data, 6, 2)]))
    add(_word_grams(_without_own(comments(text), repo)), NOTICE)
    parts = [p for p in re.split(r"/", path.lower()) if p]
    names = {f"dir:{p}" for p in parts[:-1]} | {f"name:{w}" for w in re.split(r"[^a-z]+", parts[-1] if parts else "") if w} | {f"pair:{a}/{b}" for a, b in zip(["", *parts[:-1]], parts[:-1])}
    add([_slot(x) for x in sorted(names | {f"lang:{lang}"})], COMPONENT)
    lines = text.split("\n")
    size = max(1, len(text))
    shape = {
        f"longest:{_bucket(max(map(len, lines)))}",
        f"mean:{_bucket(size / len(lines))}",
        f"blank:{_bucket(100 * sum(map(text.count, ' ')) / size)}",
        f"digits:{_bucket(100 * sum(c.isdigit() for c in text) / size)}",
        f"code:{_bucket(1000 * len(_CODE_WORD.findall(text)) / size)}",
        f"size:{_bucket(size)}",
    }
    add([_slot(x) for x in sorted(shape)])
    return np.concatenate(slots), np.concatenate(values)


def train(rows: list[tuple[str, str, str, str]], passes: int = 12, c: float = 1.0, c_masked: float = 0.3, held: int = 5, seed: int = 7) -> tuple[np.ndarray, float, dict]:
    """(weights, threshold, report) of a linear support-vector machine by dual coordinate descent on (repo, path, lang, text).

    One repository of ``held`` is held out by its hash; the threshold and the report come from weights that never saw it, the
    returned weights are then learned from all rows. An error on a row as it is costs ``c``, on a masked one ``c_masked``.
    The report has the held-out precision and recall of files as they are and with their giveaway notices masked. Rows of one
    kind only give a classifier that finds nothing.
    """
    xs, ys, out = [], [], []
    for repo, path, lang, text in rows:
        found = giveaways(repo, path, lang, text)
        held_out = xxhash.xxh64_intdigest(repo or "") % held == 0
        xs.append(features(repo, path, lang, text))
        ys.append(1.0 if found else -1.0)
        out.append("seen" if held_out else "train")
        bare = masked(text)
        if found and bare != text:
            xs.append(features(repo, path, lang, bare))
            ys.append(1.0)
            out.append("masked" if held_out else "train masked")
    costs = {i: c if o == "train" else c_masked for i, o in enumerate(out) if o.startswith("train")}
    if len({ys[i] for i in costs}) < 2:
        return np.zeros((1 << BITS) + 1, dtype=np.float32), 1.0, {"rows": len(rows)}
    weights, bias = _descend(xs, ys, costs, passes, seed)
    scores = np.array([float(weights[s] @ v) + bias for s, v in xs])
    kinds, y = np.array(out), np.array(ys)
    seen, hidden = kinds == "seen", (kinds == "masked") | ((kinds == "seen") & (y < 0))
    threshold = _threshold(scores[seen], y[seen])
    report = {"rows": len(rows), "seen": _quality(scores[seen], y[seen], threshold), "masked": _quality(scores[hidden], y[hidden], threshold)}
    everything = {i: c_masked if o.endswith("masked") else c for i, o in enumerate(out)}
    weights, bias = _descend(xs, ys, everything, passes, seed)
    return np.append(weights, bias).astype(np.float32), threshold, report


def _descend(xs: list, ys: list[float], costs: dict[int, float], passes: int, seed: int) -> tuple[np.ndarray, float]:
    weights = np.zeros(1 << BITS, dtype=np.float64)
    bias = 0.0
    rng = np.random.default_rng(seed)
    ids = list(costs)
    alpha = np.zeros(len(xs))
    norms = {i: float((xs[i][1] * xs[i][1]).sum()) + 1.0 for i in ids}
    for _ in range(passes):
        rng.shuffle(ids)
        for i in ids:
            s, v = xs[i]
            gradient = ys[i] * (float(weights[s] @ v) + bias) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), costs[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * ys[i]
                np.add.at(weights, s, step * v)
                bias += step
                alpha[i] = new
    return weights, bias


def _threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The score, in the middle of the widest gap, with the fewest held-out errors."""
    if len(set(y)) < 2:
        return 0.0
    order = np.sort(scores)
    cuts = (order[1:] + order[:-1]) / 2
    errors = [int(((scores > t) != (y > 0)).sum()) for t in cuts]
    best = min(errors)
    gaps = [(order[i + 1] - order[i], t) for i, (t, e) in enumerate(zip(cuts, errors)) if e == best]
    return float(max(gaps)[1])


def _quality(scores: np.ndarray, y: np.ndarray, threshold: float) -> dict:
    said = scores > threshold
    right = int((said & (y > 0)).sum())
    return {"n": len(y), "precision": right / max(1, int(said.sum())), "recall": right / max(1, int((y > 0).sum()))}


def decode(content: bytes) -> str:
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16", "replace")
    return content.decode("utf-8-sig", "replace").replace("\r\n", "\n")


def _train_task(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("file_id")
    weights, threshold, report = train([(r or "", p or "", lang or "", decode(bytes(c))) for r, p, lang, c in zip(pdf["repo"], pdf["path"], pdf["lang"], pdf["content"])])
    return pd.DataFrame({"weights": [weights.tobytes()], "threshold": [threshold], "report": [str(report)]})


def fit(files: DataFrame, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, float, str]:
    """Weights, threshold and report from at most ``max_rows`` files, those with the smallest hashes of their ids.

    The ids are chosen from the id column alone; content is then read of the chosen files and shuffled of no others.
    """
    chosen = files.select("file_id", F.xxhash64("file_id").alias("_h")).distinct().orderBy("_h", "file_id").limit(max_rows).select("file_id")
    sample = _rows(files).join(F.broadcast(chosen), "file_id", "left_semi").dropDuplicates(["file_id"])
    found = sample.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda pdf: _train_task(pdf), "weights binary, threshold double, report string").collect()
    if not found:
        weights, threshold, report = train([])
        return weights, threshold, str(report)
    return np.frombuffer(found[0][0], dtype=np.float32), found[0][1], found[0][2]


def _rows(files: DataFrame) -> DataFrame:
    columns = ["file_id", "repo", "path", language_of(F.col("language"), F.col("path")).alias("lang"), "content"]
    return files.select(*columns).filter("content is not null")


def not_handwritten(files: DataFrame, model: tuple[np.ndarray, float, str] | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """(file_id, score, other) of every file with content, one row per file.

    ``other`` is true where the classifier finds that nobody of the repository wrote the file by hand. Empty files are
    hand-written as far as anyone can tell, with a null score; files without content give no row; null repositories, paths and
    languages are empty ones. Rows of one file are delivered again unchanged; any is taken.
    """
    weights, threshold, _ = model or fit(files, max_rows)
    known = files.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = known.value
        for pdf in batches:
            rows = []
            for file, repo, path, lang, content in zip(pdf["file_id"], pdf["repo"], pdf["path"], pdf["lang"], pdf["content"]):
                text = decode(bytes(content))
                if not text.strip():
                    rows.append((file, None, False))
                    continue
                slots, values = features(repo or "", path or "", lang or "", text)
                s = float(weights[slots] @ values) + float(weights[-1])
                rows.append((file, s, s > threshold))
            yield pd.DataFrame(rows, columns=["file_id", "score", "other"])

    id_type = files.schema["file_id"].dataType.simpleString()
    scored = spread(_rows(files)).mapInPandas(score, f"file_id {id_type}, score double, other boolean")
    return scored.groupBy("file_id").agg(F.max("score").alias("score"), F.max("other").alias("other"))
