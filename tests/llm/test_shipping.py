"""Task functions and models reach executors that do not have the package."""

import subprocess
import sys

from pyspark import cloudpickle

import medallion.llm as llm
from medallion.llm import bpe, langid, toxicity


def test_functions_and_models_are_sent_by_value():
    model = langid.fit_rows(["der hund", "the dog"], ["de", "en"])
    index = toxicity.BlockIndex(None, None, None, 0)
    blob = cloudpickle.dumps((model, index, bpe.PairTable, langid.fit_rows))
    code = ("import sys, pickle; model, index, table, fit = pickle.load(sys.stdin.buffer); "
            "import numpy; print(model.predict(['der hund'], numpy.zeros(266304, dtype=bool))[0], "
            "'medallion' in sys.modules)")
    done = subprocess.run([sys.executable, "-c", code], input=blob, capture_output=True, cwd="/")
    assert done.stdout.decode().split() == ["['de']", "False"], done.stderr.decode()
    assert llm.__name__ == "medallion.llm"
