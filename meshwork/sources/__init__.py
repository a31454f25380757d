"""Reading and writing files, foreign databases and whole catalogs."""
