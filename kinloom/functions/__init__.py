"""kinloom.functions"""
