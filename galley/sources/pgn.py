"""Game files: reading into rows of games and moves, writing back, with every branch checked."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.chess import START, Move, Position

RESULTS = ("1-0", "0-1", "1/2-1/2", "*")
GAME_FIELDS = "path string, game_no int, headers map<string,string>, start_fen string, result string, error string, moves array<struct<path: array<int>, ply: int, uci: string, san: string, nags: array<int>, comment: string, starting_comment: string>>"


@dataclass
class Node:
    move: Move | None = None
    san: str = ""
    nags: list[int] = field(default_factory=list)
    comment: str = ""
    before: str = ""
    children: list[Node] = field(default_factory=list)


@dataclass
class Game:
    headers: dict[str, str] = field(default_factory=dict)
    root: Node = field(default_factory=Node)
    result: str = "*"
    error: str | None = None

    def start(self) -> str:
        return self.headers.get("FEN") or START

    def rows(self) -> list[tuple[list[int], int, Node, Position]]:
        """(path, ply, node, position before) of all nodes, main line first at every branch."""
        out = []
        todo: list[tuple[Node, list[int], Position]] = [(self.root, [], Position.of(self.start()))]
        while todo:
            node, path, p = todo.pop()
            for k in range(len(node.children) - 1, -1, -1):
                c = node.children[k]
                todo.append((c, [*path, k], p.after(c.move)))
            if node.move is not None:
                out.append((path, len(path), node, p))
        return sorted(out, key=lambda r: r[0])


_token = re.compile(r"\{([^}]*)\}|;([^\n]*)|\$(\d+)|([()])|(1-0|0-1|1/2-1/2|\*)(?![\w/-])|\d+\.(?:\.\.)?|…|\.+|([^\s(){};$]+)")
_header = re.compile(r'^\s*\[(\w+)\s+"((?:[^"\\]|\\.)*)"\]\s*$')


def split_games(text: str) -> list[tuple[dict[str, str], str]]:
    games, headers, body, in_moves = [], {}, [], False
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        h = _header.match(line)
        inside = "\n".join(body)
        if h and inside.count("{") <= inside.count("}"):
            if in_moves:
                games.append((headers, inside))
                headers, body, in_moves = {}, [], False
            headers[h[1]] = h[2].replace('\\"', '"').replace("\\\\", "\\")
        elif line.strip() or in_moves:
            body.append(line)
            in_moves = in_moves or bool(line.strip())
    if headers or "".join(body).strip():
        games.append((headers, "\n".join(body)))
    return games


def parse_game(headers: dict[str, str], body: str) -> Game:
    """One game; ``error`` tells the first move that is not legal, what follows it in its line is left out."""
    game = Game(dict(headers))
    try:
        p = Position.of(game.start())
    except ValueError as e:
        game.error = str(e)
        return game
    from ..functions.notation import NAGS

    node, stack, at, lead, broken = game.root, [], p, "", False
    positions = {id(game.root): p}
    parents: dict[int, Node] = {}
    for m in _token.finditer(body):
        text, semi, nag, paren, result, word = m.groups()
        if text is not None or semi is not None:
            note = " ".join((text if text is not None else semi).split())
            if node.move is None and node is not game.root or lead is None:
                lead = note
            elif stack and stack[-1][1]:
                lead = (lead + " " + note).strip() if lead else note
            else:
                node.comment = (node.comment + " " + note).strip()
        elif nag:
            if node.move is not None and int(nag) not in node.nags:
                node.nags.append(int(nag))
        elif paren == "(":
            stack.append([node, True, broken, lead])
            lead = ""
            node = parents.get(id(node), game.root)
            at = positions[id(node)]
        elif paren == ")":
            if stack:
                node, _, broken, lead = stack.pop()
                at = positions[id(node)]
        elif result:
            if not stack:
                game.result = result
        elif word:
            if broken:
                continue
            bare = re.sub(r"^\d+\.+", "", word)
            if not bare:
                continue
            core = bare.rstrip("!?")
            marks = bare[len(core) :]
            move = at.read(core)
            if move is None:
                if game.error is None:
                    game.error = f"no such move: {word}"
                broken = True
                continue
            old = next((c for c in node.children if c.move == move), None)
            new = old or Node(move, at.san(move))
            if old is None:
                node.children.append(new)
            if marks in NAGS and NAGS[marks] not in new.nags:
                new.nags.append(NAGS[marks])
            if lead:
                new.before = lead
                lead = ""
            parents[id(new)] = node
            at = at.after(move)
            node = new
            positions[id(node)] = at
            if stack:
                stack[-1][1] = False
    game.result = game.headers.get("Result", game.result) if game.result == "*" else game.result
    return game


def parse_pgn(text: str) -> list[Game]:
    return [parse_game(h, b) for h, b in split_games(text)]


def decoded(raw: bytes) -> str:
    """UTF-8, with or without a mark, else cp1252."""
    try:
        return raw.decode("utf-8-sig")
    except UnicodeDecodeError:
        return raw.decode("cp1252", "replace")


def written(game: Game) -> str:
    """A game as text; numbers come back after comments and variations."""
    order = ["Event", "Site", "Date", "Round", "White", "Black", "Result"]
    headers = {k: game.headers.get(k, {"Date": "????.??.??", "Result": game.result}.get(k, "?")) for k in order}
    headers |= {k: v for k, v in game.headers.items() if k not in headers}
    headers["Result"] = game.result
    esc = lambda v: v.replace("\\", "\\\\").replace('"', '\\"')
    out = [f'[{k} "{esc(v)}"]' for k, v in headers.items()]
    words: list[str] = []

    def note(t: str) -> None:
        if t:
            words.append("{" + t.replace("}", ")") + "}")

    def one(p: Position, c: Node, number: bool) -> None:
        note(c.before)
        if p.white:
            words.append(f"{p.full}.")
        elif number or c.before:
            words.append(f"{p.full}...")
        words.append(p.san(c.move))
        words.extend(f"${n}" for n in sorted(c.nags))
        note(c.comment)

    def line(node: Node, p: Position, number: bool) -> None:
        while node.children:
            first, *rest = node.children
            one(p, first, number)
            number = bool(first.comment)
            for r in rest:
                words.append("(")
                one(p, r, True)
                line(r, p.after(r.move), bool(r.comment))
                words.append(")")
                number = True
            p = p.after(first.move)
            node = first

    note(game.root.comment)
    line(game.root, Position.of(game.start()), True)
    words.append(game.result)
    body = " ".join(words).replace("( ", "(").replace(" )", ")")
    rows, row = [], ""
    for w in body.split(" "):
        if row and len(row) + 1 + len(w) > 79:
            rows.append(row)
            row = w
        else:
            row = f"{row} {w}" if row else w
    return "\n".join(out) + "\n\n" + "\n".join([*rows, row]) + "\n"


def signature(game: Game) -> list:
    """What must be equal for two trees to be equal."""
    return [game.start(), *((tuple(path), n.move.uci(), n.comment, n.before, tuple(sorted(n.nags))) for path, _, n, _ in game.rows())]


def checked(games: list[Game]) -> str:
    """The text of games, read again and compared with what was written; ValueError if anything differs."""
    text = "\n".join(map(written, games))
    again = parse_pgn(text)
    if len(again) != len(games):
        raise ValueError(f"{len(games)} games were written, {len(again)} read")
    for a, b in zip(games, again):
        if b.error or signature(a) != signature(b) or any(b.headers.get(k) != v for k, v in a.headers.items() if k != "Result"):
            raise ValueError(f"a game came back changed: {b.error or a.headers}")
    return text


def game_row(path: str, no: int, g: Game) -> tuple:
    try:
        moves = [{"path": p, "ply": n, "uci": x.move.uci(), "san": x.san, "nags": sorted(x.nags), "comment": x.comment, "starting_comment": x.before} for p, n, x, _ in g.rows()]
        start = g.start()
    except ValueError:
        moves, start = [], None
    return (path, no, g.headers, start, g.result, g.error, moves)


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.strict = options["path"], options.get("mode", "permissive").lower() == "failfast"

    def partitions(self) -> list[InputPartition]:
        root = re.sub("^file:(//)?", "", self.path)
        if os.path.isfile(root):
            return [_Part(root)]
        return [_Part(os.path.join(d, f)) for d, _, files in sorted(os.walk(root)) for f in sorted(files) if f.lower().endswith(".pgn")]

    def read(self, part: _Part) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            games = parse_pgn(decoded(f.read()))
        if self.strict and (not games or any(g.error for g in games)):
            raise ValueError(f"{part.path}: {next((g.error for g in games if g.error), 'no games')}")
        for no, g in enumerate(games, 1):
            yield game_row(part.path, no, g)


class PgnSource(DataSource):
    """spark.read.format("pgn").load(folder): one partition per file, one row per game."""

    @classmethod
    def name(cls) -> str:
        return "pgn"

    def schema(self) -> str:
        return GAME_FIELDS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, path: str, mode: str = "permissive") -> DataFrame:
    spark.dataSource.register(PgnSource)
    return spark.read.format("pgn").option("mode", mode).load(path)
