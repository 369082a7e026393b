"""lorebank.functions"""
