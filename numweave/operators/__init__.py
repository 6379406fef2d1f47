"""DataFrame -> DataFrame operators.

order     global_index, smallest_by_hash, top_k_per_group, global_rank
generate  gen_operands, gen_pairs_* (add, decimal, sub, mul, dense mul, stratified mul),
          gen_triples_label(_balanced), score distribution, median threshold, dedupe, limit_n
split     index_by_hash, split_positional, split_random, head_n, nested_prefixes
text      explode_numbers, max_number, number_token_stats, tokenize_masked, question_len,
          project_qa, serialize_tabular, concat_question_label, vocab_build, encode_token_ids,
          lookup_token_vectors
collate   batch ids, padding, attention mask, number scatter, last token, loss labels, pooling
encode    encode_periodic(_shift), encode_digits, encode_logscale, combine_additive, layer_norm,
          apply_linear, filter_nonzero_mask
decode    digit_logits, decode_periodic, loss_digit_ce, decode_digits, loss_digit_rms, head_linear,
          loss_log_mse, decode_logscale
metrics   tolerance / string / character / digit accuracy, MSE, R^2, batch-mean loss, eval_report,
          mispredictions, samples, early stop
runs      run keys, latest log, field extraction, nan filter, last values, summaries, curves
"""
