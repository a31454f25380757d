"""From query text to DataFrames: lexer, parser, lowering."""
