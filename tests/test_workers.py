import os
import subprocess
import sys

from pyspark import cloudpickle

from flowskein.operators import hierarchy
from flowskein.sources import files


def test_worker_functions_need_no_package():
    for function in (hierarchy._core_task(True), files.channels_of):
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        code = "import pickle, sys; pickle.loads(sys.stdin.buffer.read()); assert 'flowskein' not in sys.modules"
        subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(function), cwd="/", env=env, check=True, timeout=60)
