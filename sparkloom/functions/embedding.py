"""The seam for neural embeddings: a model's batch function over an image column, loaded once a worker.

No model comes with the engine; the ``embeddings`` table, or ``pixels.describe``'s texture, stand in for one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.pixels import to_rgb, to_tensor


def embed(make_predict: Callable[[], Callable[[np.ndarray], np.ndarray]], column: str = "image", *, size: int = 224, grayscale: bool = False, batch: int = 32) -> Column:
    """Embeddings of an image column.

    make_predict runs once a worker and gives a function from a batch (n, 3, size, size) to (n, dimensions);
    images that couldn't be decoded are given as zeros.
    """

    def make():
        predict = make_predict()

        def run(height: np.ndarray, width: np.ndarray, channels: np.ndarray, data: np.ndarray) -> np.ndarray:
            x = np.zeros((len(data), 3, size, size), np.float32)
            for k, (h, w, c, d) in enumerate(zip(height, width, channels, data, strict=True)):
                if (rgb := to_rgb(int(h), int(w), int(c), d)) is not None:
                    x[k] = to_tensor(rgb, size, grayscale)
            return np.asarray(predict(x), np.float32)

        return run

    f = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    image = F.col(column)
    return f(image["height"], image["width"], image["nChannels"], image["data"])
