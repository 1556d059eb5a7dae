"""Model configurations in odd shapes."""

from sparkreef.sources import configs

CONFIG = """# a comment
macros:
  "root": "/models"
  run: 'serve -m ${root}'
  "root": "/other"
  "deep": "${run}/x"
other:
  models:
    "no": 1
models:
  "a-1":
    name: "Model: one"
    aliases: ["x", 'y', z]
    cmd: |
      ${deep}.gguf
      -c 10 --temp 0.5

      -c 20 ${unknown} {brace}
    ttl: 5
  plain:
    aliases:
      - one
      - "two"
    cmd: serve --temp
  "empty":
  "a-2":
    aliases: []
    name: ""
    cmd: |
tail: x
"""


def read(spark, text, flags=("-m", "-c", "--temp")):
    rows = configs.model_entries(spark.createDataFrame([(1, text)], "k int, t string"), "t", flags, ["k"]).collect()
    return {r.id: (r.name, list(r.aliases), r.command, r.flags) for r in rows}


WANTED = {
    "a-1": ("Model: one", ["x", "y", "z"], "serve -m /other/x.gguf -c 10 --temp 0.5 -c 20 ${unknown} {brace}", {"-m": "x.gguf", "-c": "10", "--temp": "0.5"}),
    "plain": ("plain", ["one", "two"], "serve --temp", {}),
    "empty": ("empty", [], "", {}),
    "a-2": ("a-2", [], "", {}),
}


def test_shapes(spark):
    assert read(spark, CONFIG) == WANTED


def test_line_ends(spark):
    assert read(spark, CONFIG.replace("\n", "\r\n")) == WANTED
    assert read(spark, CONFIG.removesuffix("tail: x\n").rstrip()) == WANTED


def test_nothing_to_read(spark):
    for text in (None, "", "macros:\n  a: b\n", "models:\n", "models:", "[]", "models:\n    name: x\n"):
        assert read(spark, text) == {}


def test_macros_that_bring_themselves(spark):
    text = 'macros:\n  a: "${b}"\n  b: "${a}!"\nmodels:\n  m:\n    cmd: "x"\n  n:\n    cmd: ${a}\n'
    assert read(spark, text)["n"][2].count("!") == 1
