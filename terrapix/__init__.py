"""terrapix: habitat analytics from satellite observations on Spark DataFrames.

Subpackages:
    sources    -- table readers, fixture views, sinks
    functions  -- Column expressions (masks, reflectance, indices, path years)
    operators  -- DataFrame -> DataFrame operators (composite, labels, samples,
                  metrics, reports, model)
    plans      -- named end-to-end queries and their SQL oracles
    streaming  -- the stateless observation stage on streaming DataFrames
"""

__version__ = "0.1.0"
