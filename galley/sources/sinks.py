"""Writing results: atomic files, JSON, game files that were read again before they count, books as HTML."""

from __future__ import annotations

import html
import json
import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame

from ..functions.chess import Position
from . import pgn


def atomic_text(path: str, text: str) -> None:
    """A file appears whole or not at all; what was there stays on failure."""
    folder = os.path.dirname(os.path.abspath(path))
    fd, temp = tempfile.mkstemp(dir=folder, prefix=".part-")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="\n") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise


def write_json(path: str, data) -> None:
    atomic_text(path, json.dumps(data, ensure_ascii=False, indent=2) + "\n")


def report_path(destination: str) -> str:
    return f"{destination}.report.json"


def tree(headers: dict[str, str], moves: list[dict], result: str) -> pgn.Game:
    """A game from its rows (path, uci, nags, comment, starting_comment)."""
    game = pgn.Game(dict(headers), result=result)
    nodes = {(): (game.root, Position.of(game.start()))}
    for m in sorted(moves, key=lambda m: m["path"]):
        node, p = nodes[tuple(m["path"][:-1])]
        move = next((x for x in p.legal() if x.uci() == m["uci"]), None)
        if move is None:
            raise ValueError(f"{m['uci']} is not legal in {p.fen()}")
        new = pgn.Node(move, p.san(move), list(m["nags"] or []), m["comment"] or "", m["starting_comment"] or "")
        node.children.append(new)
        nodes[tuple(m["path"])] = (new, p.after(move))
    return game


def write_pgn(games: DataFrame, moves: DataFrame, keys: list[str], path: str, strict_issues: DataFrame | None = None) -> int:
    """Games and moves of one book as a game file, checked by reading it again.  With ``strict_issues``, any issue that is
    more than information leaves the file alone and is an error.  One book is gathered here, no more."""
    if strict_issues is not None and not strict_issues.where("severity <> 'info'").isEmpty():
        raise ValueError("the book needs review; nothing was written")
    own: dict[tuple, list[dict]] = {}
    for m in moves.select(*keys, "path", "uci", "nags", "comment", "starting_comment").toLocalIterator():
        own.setdefault(tuple(m[k] for k in keys), []).append(m.asDict())
    trees = [tree(g["headers"] or {}, own.get(tuple(g[k] for k in keys), []), g["result"] or "*") for g in games.orderBy(*keys).toLocalIterator()]
    atomic_text(path, pgn.checked(trees))
    return len(trees)


def checks(source: str, destination: str, report: str | None) -> None:
    """A report may be neither the input nor the output."""
    if report and Path(report).resolve() in (Path(source).resolve(), Path(destination).resolve()):
        raise ValueError("the report needs a path of its own")


FIGURINES = str.maketrans("KQRBN", "♔♕♖♗♘")
RUSSIAN = {"K": "Кр", "Q": "Ф", "R": "Л", "B": "С", "N": "К"}
NAG_TEXT = {1: "!", 2: "?", 3: "!!", 4: "??", 5: "!?", 6: "?!", 10: "=", 13: "∞", 14: "⩲", 15: "⩱", 16: "±", 17: "∓", 18: "+-", 19: "-+"}


def printed(san: str, pieces: str) -> str:
    if pieces == "figurine":
        return san.translate(FIGURINES)
    if pieces == "ru":
        return re.sub("[KQRBN]", lambda m: RUSSIAN[m[0]], san)
    return san


def comment(text: str) -> str:
    return html.escape(re.sub(r"\[%[^\]]*\]|\[#\]", "", text).strip(), quote=False)


def diagram(placement: str) -> str:
    rows = (re.sub(r"\d", lambda m: "." * int(m[0]), r) for r in placement.split("/"))
    return "<pre>" + "\n".join(" ".join(r) for r in rows) + "</pre>"


def movetext(game: pgn.Game, pieces: str = "letters", comments: bool = True) -> str:
    """Moves with nested variations; a number comes back after a comment or a variation."""
    out: list[str] = []

    def one(p: Position, n: pgn.Node, number: bool) -> bool:
        if n.before and comments:
            out.append(f"<i>{comment(n.before)}</i>")
            number = True
        if p.white or number:
            out.append(f"{p.full}{'.' if p.white else '...'}")
        out.append(printed(n.san, pieces) + "".join(NAG_TEXT.get(k, f"${k}") for k in sorted(n.nags)))
        if n.comment and comments:
            out.append(f"<i>{comment(n.comment)}</i>")
        return bool(n.comment and comments)

    def line(node: pgn.Node, p: Position, number: bool) -> None:
        while node.children:
            first, *rest = node.children
            number = one(p, first, number)
            for r in rest:
                out.append("(")
                line(r, p.after(r.move), one(p, r, True))
                out.append(")")
                number = True
            p, node = p.after(first.move), first

    line(game.root, Position.of(game.start()), True)
    return " ".join(out).replace("( ", "(").replace(" )", ")")


def blocks(game: pgn.Game, index: int, pieces: str = "letters", comments: bool = True, final: bool = True) -> str:
    """A game as HTML: title, what is known of the event, players, set-up, moves, final diagram, result."""
    h = game.headers
    known = lambda k: "" if set(h.get(k, "?")) <= set("?.") else h[k]
    out = [f"<h2>{index}. {html.escape(known('Event'))}</h2>".replace(". </h2>", "</h2>")]
    info = " · ".join(html.escape(x) for k in ("Site", "Date", "Round") if (x := known(k)))
    if info:
        out.append(f"<p>{info}</p>")
    if known("White") or known("Black"):
        out.append(f"<p><b>{html.escape(known('White') or '?')} – {html.escape(known('Black') or '?')}</b></p>")
    if h.get("FEN"):
        out.append(diagram(h["FEN"].split(" ")[0]))
    if game.root.comment and comments:
        out.append(f"<p><i>{comment(game.root.comment)}</i></p>")
    out.append(f"<p>{movetext(game, pieces, comments)}</p>")
    p, node = Position.of(game.start()), game.root
    while node.children:
        node = node.children[0]
        p = p.after(node.move)
    if final:
        out.append(diagram(p.placement()))
    out.append(f"<p>{game.result}</p>")
    return "\n".join(out)
