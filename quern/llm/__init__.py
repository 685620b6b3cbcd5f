"""Training-data operators: tokens, URLs, near copies, search, leaks, secrets, toxicity, chat.

Every operator takes DataFrames and returns a DataFrame. Common rules, for all of them:

* a null text counts as the empty text unless the operator says otherwise;
* only the named columns are read, so further columns of any name are ignored;
* rows repeated in the input are answered once each, in the same way;
* an empty table gives an empty result with the same schema.
"""
