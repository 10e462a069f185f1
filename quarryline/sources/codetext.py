"""Source text of program blocks from their XML tokens: structured text (SCL) and statement lists (STL).

One writer walks the tokens; a dialect says how symbols and calls are written.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

#: Statement tokens with their mnemonics; sizes of addresses.
MNEMONICS = {
    "Assign": "=", "A_BRACK": "A(", "AN_BRACK": "AN(", "O_BRACK": "O(", "ON_BRACK": "ON(", "BRACKET": ")", "NOP_0": "NOP 0", "ADD_R": "+R", "SUB_R": "-R",
    "MUL_R": "*R", "DIV_R": "/R", "Rise": "FP", "Fall": "FN", "OnDelay": "SD", "OffDelay": "SF",
}
SIZES = {"Bool": "X", "Byte": "B", "Word": "W", "DWord": "D"}


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def named(node: ET.Element, *names: str) -> Iterator[ET.Element]:
    return (e for e in node if local(e.tag) in names)


def address(e: ET.Element) -> str:
    area, kind, offset = e.get("Area") or "", e.get("Type") or "", e.get("BitOffset") or "0"
    bits = int(offset) if offset.lstrip("-").isdigit() else 0
    at = f"{bits // 8}.{bits % 8}" if kind == "Bool" else f"{bits // 8}"
    if area == "DB" and e.get("BlockNumber"):
        return f"%DB{e.get('BlockNumber')}.DB{SIZES.get(kind, 'B')}{at}"
    if area in ("I", "Q", "M"):
        return f"%{area}{'' if kind == 'Bool' else SIZES.get(kind, '')}{at}"
    return f"[{area}:{kind}@{bits}]"


def comment(node: ET.Element) -> str:
    return "".join(t.text or "" for t in named(node, "Text")) or (node.text or "").strip()


def label(parameter: ET.Element) -> str:
    """Section and type of a call's parameter, as a note."""
    found = "/".join(x for x in (parameter.get("Section"), parameter.get("Type")) if x)
    return f"  [{found}]" if found else ""


class Writer:
    """Writes accesses; ``quote_later`` asks whether a later part of a symbol is quoted too where its mark says so."""

    def __init__(self, statements: bool):
        self.statements = statements

    def symbol(self, node: ET.Element, head: str) -> str:
        """head: what a name begins with; in statements and for global names the first part is quoted."""
        out = []
        for symbol in named(node, "Symbol"):
            for c in symbol:
                if local(c.tag) == "Component":
                    name = c.get("Name") or ""
                    marked = any(b.get("Name") == "HasQuotes" and b.text == "true" for b in named(c, "BooleanAttribute"))
                    quoted = marked if out else self.statements or head == ""
                    out.append(f'"{name}"' if quoted else name)
                    for index in named(c, "Access"):
                        out[-1] += f"[{self.access(index)}]"
                elif local(c.tag) == "Access" and c.get("AccessModifier") == "Array" and out:
                    out[-1] += f"[{self.access(c)}]"
        return head + ".".join(out)

    def access(self, e: ET.Element) -> str:
        scope = e.get("Scope") or ""
        if scope == "Call":
            return "".join(self.call(c) for c in named(e, "CallInfo", "Instruction"))
        if scope == "Address":
            return "".join(address(a) for a in named(e, "Address"))
        if scope in ("LiteralConstant", "TypedConstant"):
            return "".join(v.text or "" for c in named(e, "Constant") for v in named(c, "ConstantValue"))
        if scope in ("LocalConstant", "GlobalConstant"):
            names = [c.get("Name") or "" for c in named(e, "Constant")]
            return (f"#{names[0]}" if scope == "LocalConstant" else f'"{names[0]}"') if names else self.symbol(e, "#")
        return self.symbol(e, "#" if scope == "LocalVariable" else "")

    def call(self, info: ET.Element) -> str:
        name = info.get("Name") or ""
        plain = self.statements and local(info.tag) == "Instruction"
        out = [name if plain or not name else f'"{name}"']
        for part in info:
            kind = local(part.tag)
            if kind == "Instance":
                own = ".".join(c.get("Name") or "" for c in named(part, "Component"))
                if own:
                    here = part.get("Scope") == "LocalVariable"
                    out.append(f", #{own}" if here else f', "{own}"' if self.statements else f", {own}")
            elif kind == "Parameter":
                inner = self.tokens(part)
                if self.statements:
                    out.append(f"\n        {part.get('Name') or ''} := {inner}")
                else:
                    out.append((part.get("Name") or "") + (inner if len(part) else " := "))
                out.append(label(part))
            elif kind == "NamelessParameter":
                out.append(self.tokens(part))
            elif not self.statements:
                out.append(self.token(part))
        return "".join(out)

    def token(self, e: ET.Element) -> str:
        kind, n = local(e.tag), int(e.get("Num") or 1)
        if kind in ("Token", "NamePart"):
            return e.get("Text") or ""
        if kind in ("Date", "Time"):
            return e.get("Value") or ""
        if kind == "Blank":
            return " " * n
        if kind == "NewLine":
            return "\n" * n
        if kind == "Text":
            return e.text or ""
        if kind == "LineComment":
            return f"//{comment(e)}"
        if kind == "BlockComment":
            return "(*" + "".join("\n" if local(s.tag) == "NewLine" else s.text or "" for s in named(e, "Text", "NewLine")) + "*)"
        return self.access(e) if kind == "Access" else ""

    def tokens(self, node: ET.Element) -> str:
        return "".join(self.token(e) for e in node)


def structured_text(node: ET.Element) -> str:
    """The code of a text block: its tokens, or its own text where it has none, as older exports write it; ends are trimmed."""
    return (Writer(statements=False).tokens(node) if len(node) else node.text or "").strip()


def statement_list(node: ET.Element) -> str:
    """One line for each statement: mnemonic, operand, comment."""
    writer, out = Writer(statements=True), []
    for s in named(node, "StlStatement"):
        token = next(named(s, "StlToken"), None)
        name = token.get("Text") or "" if token is not None else None
        if name == "EMPTY_LINE":
            out.append("")
        elif name == "COMMENT":
            out += [f"      //{t.text}" for c in named(s, "LineComment") for t in named(c, "Text") if t.text]
        elif MNEMONICS.get(name) == ")":
            out.append("      )")
        else:
            line = "" if name is None else f"      {MNEMONICS.get(name, name)}     "
            for e in s:
                if local(e.tag) == "Access":
                    notes = [comment(c).strip() for c in named(e, "LineComment")]
                    line += writer.access(e) + "".join(f"  //{n}" for n in notes if n)
                elif local(e.tag) in ("Comment", "LineComment"):
                    line += f"  //{comment(e).strip()}"
            out.append(line)
    return "\n".join(out).rstrip()
