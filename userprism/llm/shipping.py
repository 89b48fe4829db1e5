"""The package as a file that Spark hands to its Python workers."""

import os
import tempfile
import zipfile

import userprism

_done = set()


def ship(spark):
    """Let Python workers import this package, wherever the driver found it; once per application."""
    context = spark.sparkContext
    if context.applicationId in _done:
        return
    top = os.path.dirname(os.path.abspath(userprism.__file__))
    if os.path.isdir(top):  # else it came as such a file itself
        path = os.path.join(tempfile.mkdtemp(prefix="userprism-"), "userprism.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(top):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(top)))
        context.addPyFile(path)
    _done.add(context.applicationId)
