import os
import subprocess
import sys

import pytest
from pyspark import cloudpickle

from rankloom.llm import canon, names, personal, scans, split, tokens

THINGS = [personal.Finder, personal.Surrogates, personal.canonical, names.compare, names.tokens_of, canon.Index, scans.Page, scans.Lexicon, split.split_text, tokens.encode_text]


@pytest.mark.parametrize("thing", THINGS, ids=lambda t: t.__qualname__)
def test_code_reaches_workers_without_the_package(thing):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import sys; from pyspark import cloudpickle; cloudpickle.loads(sys.stdin.buffer.read()); assert 'rankloom' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(thing), cwd="/", env=env, check=True, timeout=60)
