"""Training-data operators: language identification, sharding, URL filtering,
decontamination, packing, substring and near-duplicate removal, vector search,
importance resampling and page extraction. Nothing outside this subpackage imports it."""
