"""Kernels of a text as functions of the JVM: TextKernel.java, compiled by Spark's own compiler and sent to the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

FACTOR = "struct<phrase_no: bigint, pos: bigint, src: bigint, len: bigint, literal: bigint>"
PHRASE = "struct<beg: bigint, end: bigint, src: bigint>"
#: What a kernel gives.
TYPES = {
    "factors": f"array<{FACTOR}>", "decode": "binary", "phrases": f"array<{PHRASE}>", "select": f"array<{PHRASE}>",
    "counts": "array<struct<bytes: bigint, factors: bigint, literals: bigint, encoded_bits: bigint>>", "statistics": "array<struct<bytes: bigint, phrases: bigint, covered: bigint, gaps: bigint>>",
    "gapped": "array<struct<step: bigint, kind: string, src: bigint, len: bigint>>", "gapped_file": "binary", "read_gapped": "binary",
}
#: The compiled class of each session that has it.
_compiled: dict[tuple[int, str], object] = {}


def _class(spark: SparkSession):
    """The kernels' class in the driver; its jar is added to the session, which hands it to the executors."""
    key = (id(spark.sparkContext), spark._jsparkSession.sessionUUID())
    if key not in _compiled:
        jvm = spark._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook((Path(__file__).parent / "TextKernel.java").read_text())
        folder = tempfile.mkdtemp(prefix="refrain-jar-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = f"{folder}/refrain-{uuid.uuid4().hex}.jar"  # jars of several sessions need names of their own
        with zipfile.ZipFile(path, "w") as jar:
            for name, code in dict(compiler.getBytecodes()).items():
                jar.writestr(name.replace(".", "/") + ".class", bytes(code))
        spark.sql(f"ADD JAR '{path}'")
        _compiled[key] = compiler.getClassLoader().loadClass("refrain.TextKernel")
    return _compiled[key]


def kernel(spark: SparkSession, what: str, tau: int = 0, mode: str = "lpf_opt", fill: str = "greedy", sections: int = 1, least: int = 1) -> Callable[[Column], Column]:
    """The kernel as a function of a column: of a text or file (binary), for decode and select of an array of factors or phrases.

    tau: density of the samples of approximate ways; 0 for exact factors."""
    args = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, 6)
    for i, x in enumerate((what, tau, mode, fill, sections, least)):
        args[i] = x
    made = _class(spark).getConstructors()[0].newInstance(args)
    name = f"_refrain_{what}_{tau}_{mode}_{fill}_{sections}_{least}"
    spark._jsparkSession.udf().register(name, made, spark._jvm.org.apache.spark.sql.types.DataType.fromDDL(TYPES[what]))
    return lambda column: F.call_function(name, column)
