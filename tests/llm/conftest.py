import random
import string

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, i string, t string, n long, slot int, units int, kept boolean, g int"


def words(rng, n):
    return " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with near copies, repeated lines, marks of all kinds, nulls, empty and very long ones."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(30, 120)) for _ in range(12)]
    out = [None, "", " \n\t ", "one", "one two", "A\n\nA\nB " + base[0], "\n".join(base[:3]), base[0] + "\n" + base[1]]
    for b in base:
        out.append(b)
        for _ in range(3):
            w = b.split(" ")
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    out += [base[3]] * 5
    out.append("\n".join(words(rng, 60) for _ in range(60)))
    out.append((base[5] + " ") * 40)
    out.append("x" * 20000)
    out.append("1" * 5000 + " a@" + "b" * 3000 + ".cc " + "@" * 500)
    out.append("mail a.b+c@d-e.org_f@g.hh, ip 1.2.3.4.5.6 and 999.1.1.1, card 4111 1111 1111 1111-0 4111-1111-1111-1111, call +49 (30) 123-456.78 or +1 2 \U0001f600 +4912345678 ï 10.0.0.255")
    out.append('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and Dr. Anna Smith, SSN 123-45-6789')
    out.append("Released under the MIT License. MIT  license; GNU General Public License! SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0\nApache\nLicense")
    out.append("你好 wörld " + SPACE + " tab\tnew\r\nline \U0001f600")
    return out


SPACE = "▁"


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(k, t, "en", ["a", "a", "a", "b", None][k % 5], 0, "x", "y", 1, 2, 3, True, 4) for k, t in enumerate(texts)]
    rows += [rows[9], rows[9]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
